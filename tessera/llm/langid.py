"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of texts known to be in it. A text, reduced to lower-case
letters and single spaces, is compressed with every dictionary; the smallest result names the language. The margin is the share by which the second smallest result is
larger, and predictions with narrow margins are rejected.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bounded sample that the dictionaries are made of. The texts of a language fall into SAMPLE_TEXTS parts by a hash, and the one with the least hash of each
#: part gives an excerpt of at most TEXT_BYTES characters, from a place that its hash names; these are taken in the order of their hashes as long as they fit into
#: SAMPLE_BYTES bytes. Of more than LANGUAGES languages those with the most texts are learned.
TEXT_BYTES, SAMPLE_TEXTS, SAMPLE_BYTES, LANGUAGES = 4096, 600, 262_144, 256
LEVEL = 6
#: Longer texts are compressed in blocks of at most so many bytes, for what a dictionary saves does not grow with a text.
BLOCK_BYTES = 16_384
#: Narrower margins are rejected.
MARGIN = 0.004
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNKNOWN = "und"


def reduced(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def sample(docs: DataFrame, text_col: str, lang_col: str) -> dict[str, bytes]:
    """Dictionary content by language, from at most SAMPLE_TEXTS texts of each.

    The parts' least hashes are aggregated, and only the texts of these are fetched: what is broadcast and collected is bounded by the parameters above.
    """
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    fit = known.filter(F.octet_length("text") >= 1).withColumn("hash", F.xxhash64("text"))
    least = fit.groupBy("lang", F.pmod("hash", F.lit(SAMPLE_TEXTS)).alias("part")).agg(F.min("hash").alias("hash"), F.count(F.lit(1)).alias("n"))
    most = least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    chosen = F.broadcast(least.join(F.broadcast(most.select("lang")), "lang").select("lang", "hash"))
    at = (F.pmod("hash", F.greatest(F.lit(1), F.length("text") - TEXT_BYTES).cast("long")) + 1).cast("int")
    excerpts = fit.join(chosen, ["lang", "hash"]).groupBy("lang", "hash").agg(F.min(F.substring("text", at, F.lit(TEXT_BYTES))).alias("text"))
    upto = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0))
    out: dict[str, list] = {}
    for r in excerpts.withColumn("upto", upto).filter((F.col("upto") <= SAMPLE_BYTES) | (F.col("upto") == F.octet_length("text") + 1)).orderBy("lang", "hash").collect():
        out.setdefault(r.lang, []).append(reduced(r.text))
    return {k: b" ".join(v) for k, v in out.items()}


@functools.lru_cache(maxsize=4)
def _compressors(contents: tuple[tuple[str, bytes], ...]):
    out = []
    for lang, content in contents:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False)))
    return out


def classify(text: str, compressors) -> tuple[str, float]:
    """Language and margin: (second - best) / second of the compressed sizes, 1 with a single language; ties go to the first by name.

    The sizes of a long text are sums over blocks of equal length, so that its margin is that of its blocks.
    """
    if not compressors or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    data = reduced(text)
    step = -(-len(data) // max(1, -(-len(data) // BLOCK_BYTES))) or 1
    blocks = [data[i : i + step] for i in range(0, max(1, len(data)), step)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
    return sizes[0][1], 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, training: DataFrame, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[Column] = ()) -> DataFrame:
    """Language of every text of docs, learned from text and language of training.

    Returns id_col, lang_pred, score (the margin, 0 to 1), rejected (narrow margin, or no language), then the columns in keep.
    A null text, one without letters, and every text where nothing was learned gets `und`, score 0. Rows of training
    without text or language teach nothing; ties go to the first language by name; repeated rows are judged alike; an empty table gives an empty
    result; other columns are ignored. A very long text is compressed whole, in blocks, in one task.
    """
    contents = tuple(sorted(sample(training, text_col, lang_col).items()))
    known = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches):
        compressors = _compressors(known.value)
        for batch in batches:
            found = [classify(t or "", compressors) for t in batch.column(1).to_pylist()]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, scores, *batch.columns[2:]], [id_col, "lang_pred", "score", *batch.schema.names[2:]])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    out = rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double{kept}")
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < margin)
    return out.select(id_col, "lang_pred", "score", rejected.alias("rejected"), *[F.col(f"`{f.name}`") for f in rows.schema.fields[2:]])


def identified(docs: DataFrame, training: DataFrame, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is clear, with lang_col as predicted; all columns of docs, in their order."""
    found = identify(docs, training, margin, id_col, text_col, lang_col, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")])
    return found.filter(~F.col("rejected")).select(*[F.col("lang_pred").alias(c) if c == lang_col else F.col(f"_row.`{c}`") for c in docs.columns])
