"""Quality rules: measures of each text, and removal of lines that many documents of a host share.

Lines are normalised (ASCII lower case, digits as 0, single spaces) and hashed. A line is above the limits of a host
when more than MIN_DOCS of its documents hold it, and these are more than SHARE of them or more than MANY. Documents are
counted by their id, rows without one each by itself. Such lines go from all documents of the host, but on request a
first document keeps them, so that the content survives. A document that keeps too little is depleted and rejected, as is one that fails the base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fits, stash

MIN_DOCS, SHARE, MANY = 5, 0.05, 1000
#: A document is depleted if it keeps fewer words than this, or a smaller share of them.
LEAST_WORDS, LEAST_SHARE = 10, 0.4
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
NORMAL = bytes(ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd multipliers that combine five word hashes into one of their window.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Tables of lines above limits with up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
WINDOW = 5


def line_key(line: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(line.translate(NORMAL).split())) - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more, first occurrences included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    codes = sum(each[i : i + n] * MIX[i] for i in range(WINDOW))
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    seen, found = {}, np.zeros(n, bool)
    for i in np.sort(order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]).tolist():  # equal codes: compare the words
        first = seen.setdefault(tuple(words[i : i + WINDOW]), i)
        if first != i:
            found[[first, i]] = True
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + n] |= found
    return int(covered.sum())


def measures(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, and (key, words) of its lines with a word."""
    data = text.encode()
    words = data.split()
    lines, seen, dups = [], set(), 0
    for line in data.split(b"\n"):
        count = len(line.split())
        if count:
            dups += line in seen
            seen.add(line)
            lines.append({"key": line_key(line), "words": count})
    spaces = len(data) - len(data.translate(None, SPACES))
    return len(words), len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS)), dups, repeated_words(words), lines


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<key long, words int>>"
NAMES = [x.split()[0] for x in "n_words,word_chars,n_symbols,n_dup_lines,n_repeat_words,lines".split(",")]


def _measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs (_id, _host, _text, then keep) with measures, stashed under a row number that holds from then on."""
    lines_type = pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = [measures(t or "") for t in batch.column("_text").to_pylist()]
            types = [pa.int64()] * 5 + [lines_type]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            kept = [k for k in batch.schema.names if k != "_text" or "_text" in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], [*kept, *NAMES])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text" or "_text" in keep)
    return stash(docs.mapInArrow(run, f"{shape}, {MEASURES}").withColumn("_row", F.monotonically_increasing_id()), "quality")


def _removals(measured: DataFrame, min_docs: int, share: float, many: int, survive: bool) -> DataFrame:
    """(_row, removed, keeper): the keys of the lines to remove of each document that has any above limits, and whether it is the one that keeps any.

    To survive, a line is kept by the smallest id of those that pass the base rules, and by all of these if none has an id.
    """
    documents = F.sum(F.when(F.col("_id").isNull(), F.col("rows")).otherwise(1))
    sizes = measured.groupBy("_host", "_id").agg(F.count(F.lit(1)).alias("rows")).groupBy("_host").agg(documents.alias("docs"))
    lines = measured.select("_row", "_id", "_host", (~F.col("base_failed")).alias("may"), F.explode(F.array_distinct(F.col("lines.key"))).alias("key"))
    counted = lines.groupBy("_host", "key", "_id").agg(F.count(F.lit(1)).alias("rows"), F.max("may").alias("may"))
    counted = counted.groupBy("_host", "key").agg(documents.alias("docs_with"), F.min(F.when(F.col("may"), F.col("_id"))).alias("first"))
    null_safe = lambda a, b: a["_host"].eqNullSafe(b["_host"])
    often = counted.filter(F.col("docs_with") > min_docs)
    over = (F.col("docs_with") > share * F.col("docs")) | (F.col("docs_with") > many)
    above = often.join(sizes, null_safe(often, sizes)).filter(over).select(often["_host"], often["key"], "first")
    above = stash(above, "quality-lines")
    if fits(above, BROADCAST_ROWS):
        above = F.broadcast(above)
    keeps = F.col("may") & lines["_id"].eqNullSafe(F.col("first")) if survive else F.lit(False)
    hit = lines.join(above, null_safe(lines, above) & (lines["key"] == above["key"])).select("_row", lines["key"], keeps.alias("keeps"))
    return hit.groupBy("_row").agg(F.collect_set(F.when(~F.col("keeps"), F.col("key"))).alias("removed"), F.max("keeps").alias("keeper"))


def _judged(docs: DataFrame, keep: list[str], min_docs: int, share: float, many: int, survive: bool) -> DataFrame:
    measured = _measure(docs, keep).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = measured.join(_removals(measured, min_docs, share, many, survive), "_row", "left")
    gone = F.coalesce(F.aggregate(F.filter("lines", lambda x: F.array_contains("removed", x["key"])), F.lit(0), lambda a, x: a + x["words"]), F.lit(0)).cast("long")
    out = out.withColumn("n_removed_words", F.when(F.col("removed").isNull(), F.lit(0).cast("long")).otherwise(gone))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted)
    if not survive:
        return out
    whole = ~F.col("base_failed") & ~F.col("kept") & F.coalesce("keeper", F.lit(False))
    return out.withColumns({"removed": F.when(~whole, F.col("removed")), "n_removed_words": F.when(whole, 0).otherwise(F.col("n_removed_words")), "kept": F.col("kept") | whole})


def quality_report(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, many: int = MANY, survive: bool = False, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures and verdict of every document.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept. With survive the
    verdict is that of apply_quality_rules. A null or empty text has no words and fails; null hosts are one host; rows without id are documents
    of their own; repeated rows are one document and judged alike; equal texts of several documents count for each; other columns are ignored. A very long
    text is measured whole in one task; only hashes of its lines and its counts leave it.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).cast("string").alias("_text"))
    return _judged(named, [], min_docs, share, many, survive).select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def apply_quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, many: int = MANY, survive: bool = True, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, without the lines above limits; all columns of docs, in their order.

    With survive, every line of a document that passes the base rules is left in one document of its host at least: the
    smallest id that passes them keeps it, and one that keeps a line and would be depleted stays whole. A line of which
    no passing document has an id stays in all of these. Everything else as in quality_report.
    """
    packed = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_rest"))
    passed = _judged(packed, ["_text"], min_docs, share, many, survive).filter("kept")

    def strip(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for i, keys in enumerate(batch.column("removed").to_pylist()):
                if keys:
                    keys = set(keys)
                    texts[i] = b"\n".join(x for x in texts[i].encode().split(b"\n") if not x.split() or line_key(x) not in keys).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("_rest")], ["_text", "_rest"])

    slim = passed.select("_text", "removed", "_rest")
    out = slim.mapInArrow(strip, f"_text string, _rest {slim.schema['_rest'].dataType.simpleString()}")
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`") for c in docs.columns])
