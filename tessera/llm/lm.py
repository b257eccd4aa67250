"""Hashed maximum-entropy language model with a class-factored softmax.

Words are factored into nested classes of FAN branches, by their counts in the training texts (frequent words lie near
the top), and the probability of a word is the product of the softmaxes along its way down. Each softmax starts at the shares
that the branches have of the training tokens and adds the weights of hashed features, all jointly with the class: the previous
word, the one before it alone (skip), and both together. Words seen once, and those beyond the table of the most frequent ones,
share a leaf; inside it each has its smoothed share of the leaf's training tokens, unseen words together half a count. So the
probabilities of all words add up to one.

Texts are split once: their word ids are written and read again by every later pass. Weights are trained by distributed
gradient updates: each round broadcasts them, every task follows the gradient over all its training texts of that round, and the
changes are summed over a tree of tasks. A row that each task saw little of moves by the sum of its changes, one that
each saw much of by their mean, so that more data moves the weights further. Each training text is used in one round; the rounds
and the hashed rows grow with the training tokens, up to the memory of a task.
"""

from __future__ import annotations

import functools
import math
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash

#: Branches of a class; step; tokens of one update; tokens of a portion; limit of a weight.
FAN, STEP, CHUNK, PORTION, LIMIT = 8, 0.2, 32_768, 1 << 18, 12.0
#: Hashed rows: a quarter of the training tokens, between these powers of two (the upper one bounds the memory of a task: 20 MB).
LEAST_BITS, MOST_BITS = 12, 19
#: Training tokens of a task in a round, so that what is exchanged follows the tokens and not the partitions.
TASK_TOKENS = 1 << 21
#: What a row's accumulated squared gradient must be for half of the way from sum to mean.
SETTLED = 0.3
#: Most frequent words, of those seen twice or more, that every task holds; words longer than this are named by a digest.
TABLE, LONGEST = 262_144, 64
#: Words, distinct in their batch, that a task gathers before it adds them up and sends them on.
FLUSH = 800_000
#: Tasks, or sums of them, whose weight changes are added up in one group; rows of a group.
FAN_IN, BLOCK = 8, 1 << 14
#: Tokens (a part of CHUNK), and places of sorted rows, that are worked on at once, so that what is made on the way stays in the cache and is not mapped anew each time.
PIECE, SPAN = 2048, 1 << 14
LN10 = math.log(10)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in ASCII lower case, an empty one as the end of each, and their numbers. A null text is an end alone."""
    texts = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(texts, " ", "")))  # white space after the last word splits off the end
    return split.flatten(), split.value_lengths().to_numpy()


def names_of(words: pa.Array) -> pa.Array:
    """Long words by their digest."""
    long = pc.greater(pc.binary_length(words), LONGEST)
    if not pc.any(long).as_py():
        return words
    digests = ["\t" + xxhash.xxh3_128_hexdigest(w) for w in words.filter(long).cast(pa.binary()).to_pylist()]
    return pc.replace_with_mask(words, long, pa.array(digests, words.type))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts (one string column); the end is the empty word."""

    def run(batches):
        gathered, rows = [], 0

        def out():
            total = pa.concat_tables(gathered).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return total.select(["word", "c_sum"]).rename_columns(["word", "c"]).combine_chunks().to_batches()

        for batch in batches:
            found = words_of(batch.column(0))[0].value_counts()
            gathered.append(pa.table({"word": names_of(found.field("values")), "c": found.field("counts")}))
            rows += len(found)
            if rows > FLUSH:
                yield from out()
                gathered, rows = [], 0
        if gathered:
            yield from out()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon(NamedTuple):
    """counts by id, falling; training tokens and distinct words, of all and of the shared leaf."""

    counts: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int

    def base(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def in_rare(self, c):
        return np.log10((c + 0.5) / (self.rare_tokens + 0.5 * (self.rare_distinct + 1)))

    @property
    def bits(self) -> int:
        return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(self.tokens + 1)) - 2))

    @property
    def rounds(self) -> int:
        """Two up to a hundred million training tokens, one more for each power of ten beyond."""
        return max(2, math.ceil(math.log10(self.tokens + 1)) - 6)


def make_lexicon(counts: DataFrame) -> tuple[dict[bytes, int], Lexicon]:
    """Ids by word (long words by their digest), and the lexicon."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.filter("c > 1").orderBy(F.desc("c"), "word").limit(TABLE).toArrow()
    c = top.column("c").to_numpy().astype(np.int64)
    return {w.encode(): i for i, w in enumerate(top.column("word").to_pylist())}, Lexicon(c, int(total.n), int(total.v), int(total.n - c.sum()), int(total.v - len(c)))


class Classes(NamedTuple):
    """The nested classes. The way of leaf i are the classes and their branches at first[i] to first[i + 1], upwards."""

    first: np.ndarray
    nodes: np.ndarray
    branches: np.ndarray
    base: np.ndarray  # class, branch: log of its share; empty branches are out of reach
    mixed: np.ndarray  # hash of each class


def nested_classes(counts: np.ndarray) -> Classes:
    """Joins the FAN least frequent leaves or classes into one, again and again; the first class may have fewer branches."""
    leaves = len(counts)
    inner = -(-(leaves - 1) // (FAN - 1))
    order, weight = np.argsort(counts, kind="stable").tolist(), counts.tolist()
    parent, branch = np.full(leaves + inner, -1, np.int32), np.zeros(leaves + inner, np.int8)
    joined, i, j = [], 0, 0
    for k in range(inner):
        total = 0.0
        for b in range(FAN if k else leaves - (inner - 1) * (FAN - 1)):
            if j >= len(joined) or i < leaves and weight[order[i]] <= joined[j]:
                x, i = order[i], i + 1
                total += weight[x]
            else:
                x, j = leaves + j, j + 1
                total += joined[x - leaves]
            parent[x], branch[x] = k, b
        joined.append(total)
    base, below, joined = np.full((inner, FAN), -1e9, np.float32), np.flatnonzero(parent >= 0), np.array(joined)
    base[parent[below], branch[below]] = np.log(np.concatenate([counts, joined])[below] / joined[parent[below]])
    ways, leaf, at = [], np.arange(leaves), np.arange(leaves)
    while len(leaf := leaf[parent[at] >= 0]):
        at = at[parent[at] >= 0]
        up = parent[at]
        ways.append((leaf, up, branch[at]))
        at = up + leaves
    passed = np.bincount(np.concatenate([np.zeros(0, np.int64), *(w[0] for w in ways)]), minlength=leaves)
    first, place = np.concatenate([[0], np.cumsum(passed)]), np.zeros(leaves, np.int64)
    nodes, branches = np.empty(first[-1], np.int32), np.empty(first[-1], np.int8)
    for leaf, node, taken in ways:
        nodes[first[leaf] + place[leaf]], branches[first[leaf] + place[leaf]] = node, taken
        place[leaf] += 1
    return Classes(first, nodes, branches, base, _mixed(np.arange(1, inner + 1, dtype=np.uint64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(31)


@functools.lru_cache(maxsize=2)
def _classes(counts: bytes, rare: float) -> Classes:
    return nested_classes(np.concatenate([np.frombuffer(counts, np.int64).astype(float), [rare]]))


def classes_of(lexicon: Lexicon) -> Classes:
    """One leaf for each word of the table, then the shared one."""
    return _classes(lexicon.counts.tobytes(), max(lexicon.rare_tokens, 0.5))


class Tokens(NamedTuple):
    """Leaves of the words of several texts in a row, and what stands before each: unknown words and text starts have ids of their own."""

    ids: np.ndarray
    one: np.ndarray
    two: np.ndarray


def prepare(ids: np.ndarray, lengths: np.ndarray, leaves: int) -> Tokens:
    starts = np.cumsum(lengths) - lengths
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    one[starts] = two[starts] = leaves
    two[starts[lengths > 1] + 1] = leaves
    return Tokens(ids, one, two)


def decisions(t: Tokens, at: slice, tree: Classes, bits: int):
    """Of the tokens at this slice: how many classes each passes, these, the branches taken, and the rows of the three features."""
    begin = tree.first.take(t.ids[at])
    passed = tree.first.take(t.ids[at] + 1) - begin
    token = np.repeat(np.arange(len(passed)), passed)
    place = (begin - np.cumsum(passed) + passed).take(token)
    place += np.arange(len(token))
    nodes = tree.nodes.take(place)
    one, two = _mixed(t.one[at].astype(np.uint64) + np.uint64(1)), _mixed(t.two[at].astype(np.uint64) + np.uint64(1 << 40))
    by_class, rows = tree.mixed.take(nodes), []
    for x in (one, two, _mixed(one ^ two * np.uint64(0x165667B19E3779F9))):
        r = x.take(token)
        r ^= by_class
        r *= np.uint64(0xD6E8FEB86659FD93)
        r >>= np.uint64(64 - bits)
        rows.append(r.view(np.int64))
    return passed, nodes, tree.branches.take(place), rows


def logits_of(weights: np.ndarray, tree: Classes, nodes: np.ndarray, rows: list[np.ndarray], out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Written to out; spare is of its shape. Shares and weights are bounded, so that exponentials fit single precision as they are."""
    tree.base.take(nodes, axis=0, out=out, mode="clip")
    for r in rows:
        out += weights.take(r, axis=0, out=spare, mode="clip")
    return out


#: Products with them are sums of branches, once or for each branch again: faster than broadcasts over so few.
ONES, EACH = np.ones(FAN, np.float32), np.ones((FAN, FAN), np.float32)


def _items(x: np.ndarray) -> np.ndarray:
    """Rows as one item each."""
    return x.view(f"V{4 * FAN}").ravel()


def _summed(g: np.ndarray, keys: np.ndarray, shift: int, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that occur, ascending, and the sums of g over each, written to out. keys: row and place in g in one integer, sorted. Most rows occur once or twice; only the others need sums of stretches (as complex numbers, two columns at a time)."""
    row, place = keys >> shift, keys & (1 << shift) - 1
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    times = np.diff(starts, append=len(keys))
    out = g.take(place.take(starts), axis=0, out=out[: len(starts)], mode="clip")
    twice = np.flatnonzero(times == 2)
    _items(out)[twice] = _items(out.take(twice, axis=0, mode="clip") + g.take(place.take(starts.take(twice) + 1), axis=0, mode="clip"))
    often = np.flatnonzero(times > 2)
    if len(often):
        of = times.take(often)
        many = g.take(place[np.repeat(times > 2, times)], axis=0, mode="clip").view(np.complex64)
        _items(out)[often] = _items(np.add.reduceat(many, np.cumsum(of) - of, axis=0).view(np.float32))
    return row.take(starts), out


def _most_decisions(t: Tokens, tree: Classes, n: int) -> int:
    """Of any n tokens that are worked on at once."""
    passed = tree.first.take(t.ids + 1) - tree.first.take(t.ids)
    return max((int(passed[i : i + n].sum()) for i in range(0, len(passed), n)), default=0)


def train_on(t: Tokens, tree: Classes, weights: np.ndarray, past: np.ndarray, bits: int) -> None:
    """Follow the gradient over the tokens in updates of CHUNK, each row with a step that shrinks with its past gradients."""
    most = _most_decisions(t, tree, CHUNK)
    gradients, all_keys, shift = np.empty((most, FAN), np.float32), np.empty(3 * most, np.int64), max(1, most - 1).bit_length()
    spare, all_sums, old = np.empty((_most_decisions(t, tree, PIECE), FAN), np.float32), *np.empty((2, SPAN + 1, FAN), np.float32)
    for i in range(0, len(t.ids), CHUNK):
        n = 0
        for j in range(i, min(i + CHUNK, len(t.ids)), PIECE):
            _, nodes, branches, rows = decisions(t, slice(j, min(j + PIECE, i + CHUNK)), tree, bits)
            place = np.arange(n, n + len(nodes))
            g = logits_of(weights, tree, nodes, rows, gradients[n : n + len(nodes)], spare[: len(nodes)])
            np.exp(g, out=g)
            g /= np.matmul(g, EACH, out=spare[: len(nodes)])
            gradients.ravel()[place * FAN + branches] -= 1
            for k, r in enumerate(rows):
                r <<= shift
                r |= place
                all_keys[3 * n + k * len(place) :][: len(place)] = r
            n += len(place)
        keys = all_keys[: 3 * n]
        keys.sort()
        cuts = np.unique(np.append(np.searchsorted(keys, keys[::SPAN] >> shift << shift), len(keys))).tolist()  # all of a row in one span, so that it has SPAN + 1 rows at most
        for start, end in zip(cuts, cuts[1:]):
            which, sums = _summed(gradients, keys[start:end], shift, all_sums)
            grown = past.take(which)
            grown += np.einsum("ij,ij->i", sums, sums) / FAN
            past[which] = grown
            now = old[: len(which)]
            sums *= np.matmul((STEP / np.sqrt(grown + 1))[:, None], ONES[None], out=now)
            np.subtract(weights.take(which, axis=0, out=now, mode="clip"), sums, out=now)
            _items(weights)[which] = _items(np.clip(now, -LIMIT, LIMIT, out=now))


def log10_probabilities(t: Tokens, tree: Classes, weights: np.ndarray, bits: int) -> np.ndarray:
    """Of the leaf of each token."""
    out, buffers = np.zeros(len(t.ids)), np.empty((2, _most_decisions(t, tree, PIECE), FAN), np.float32)
    for i in range(0, len(t.ids), PIECE):
        passed, nodes, branches, rows = decisions(t, slice(i, i + PIECE), tree, bits)
        logits = logits_of(weights, tree, nodes, rows, *buffers[:, : len(nodes)])
        log_p = logits.ravel().take(np.arange(len(nodes)) * FAN + branches)
        log_p -= np.log(np.exp(logits, out=logits) @ ONES)
        upto, ends = np.concatenate([[0.0], np.cumsum(log_p, dtype=np.float64)]), np.cumsum(passed)
        out[i : i + PIECE] = upto[ends] - upto[ends - passed]
    return out / LN10


def portions(batch: pa.RecordBatch, column: int, most: int = PORTION):
    """(first row, ids, lengths) of parts of a batch with about so many tokens at most; a longer text is a part."""
    texts, start, size = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        texts.append(np.frombuffer(t.as_buffer(), np.int32))
        size += len(texts[-1])
        if size >= most or i + 1 == batch.num_rows:
            yield start, np.concatenate(texts).astype(np.int64), np.array(list(map(len, texts)))
            texts, start, size = [], i + 1, 0


def encode(named: DataFrame, ids, id_col: str) -> DataFrame:
    """Word ids of all texts, four bytes each, and the words outside the table with their numbers. named: id_col, text, training, part; ids: broadcast."""

    def run(batches):
        known = ids.value
        unknown = len(known)
        for batch in batches:
            words, lengths = words_of(batch.column(1))
            words = words.dictionary_encode()  # each distinct word is looked up once
            names, which = names_of(words.dictionary), words.indices.to_numpy()
            own = np.fromiter(map(known.get, names.cast(pa.binary()).to_numpy(zero_copy_only=False), repeat(unknown)), np.int32, len(names)).take(which)
            rest = np.flatnonzero(own == unknown)
            keys, n = np.unique(np.repeat(np.arange(len(lengths)), lengths)[rest] * max(1, len(names)) + which[rest], return_counts=True)
            of, which = np.divmod(keys, max(1, len(names)))
            others = pa.StructArray.from_arrays([names.take(pa.array(which)), pa.array(n, pa.int64())], ["word", "n"])
            ends = np.concatenate([[0], np.cumsum(lengths)]) * own.itemsize
            coded = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own)])
            others = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(lengths) + 1)), pa.int32()), others)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], coded, others], [id_col, "training", "part", "ids", "others"])

    shape = f"`{id_col}` {named.schema[0].dataType.simpleString()}, training boolean, part int, ids binary, others array<struct<word string, n long>>"
    return named.mapInArrow(run, shape).withColumn("_row", F.monotonically_increasing_id())


MESSAGE = ("change", "scale", "root", "tasks")


def _packed(change: np.ndarray, past: np.ndarray, tasks: np.ndarray) -> list[bytes]:
    """Changes of a block's rows as bytes with a scale for each row, roots of the squared gradients, and how many tasks changed a row."""
    scale = (np.abs(change).max(1) / 127).astype(np.float16).astype(np.float32)
    steps = np.rint(change / np.where(scale > 0, scale, 1)[:, None]).clip(-127, 127)
    return [np.where(scale[:, None] > 0, steps, 0).astype(np.int8).tobytes(), scale.astype(np.float16).tobytes(), np.minimum(np.sqrt(past), 6e4).astype(np.float16).tobytes(), tasks.astype(np.int32).tobytes()]


def _unpacked(change: bytes, scale: bytes, root: bytes, tasks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(change, np.int8).reshape(-1, FAN) * np.frombuffer(scale, np.float16).astype(np.float32)[:, None], np.frombuffer(root, np.float16).astype(np.float32) ** 2, np.frombuffer(tasks, np.int32)


def _added(table: pa.Table) -> pa.Table:
    """Sums of one block over the tasks of a group."""
    total = None
    for row in zip(*(table.column(x).to_pylist() for x in MESSAGE)):
        one = _unpacked(*row)
        total = one if total is None else tuple(a + b for a, b in zip(total, one))
    return pa.table({"near": table.column("near")[:1].combine_chunks(), "block": table.column("block")[:1].combine_chunks(), **{k: pa.array([x], pa.binary()) for k, x in zip(MESSAGE, _packed(*total))}})


def train(encoded: DataFrame, lexicon, rounds: int, bits: int) -> np.ndarray:
    """encoded: ids and part (a number below 2 ** 16); lexicon: broadcast. Returns the weights, by row and branch."""
    spark, weights = encoded.sparkSession, np.zeros((1 << bits, FAN), np.float32)
    block = min(BLOCK, 1 << bits)
    tasks = max(1, math.ceil(lexicon.value.tokens / rounds / TASK_TOKENS))
    fields = "block int, change binary, scale binary, root binary, tasks binary"
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches):
            start, past, tree = shared.value, np.zeros(1 << bits, np.float32), classes_of(lexicon.value)
            now = start.copy()
            for batch in batches:
                for _, ids, lengths in portions(batch, 0):
                    train_on(prepare(ids, lengths, len(lexicon.value.counts) + 1), tree, now, past, bits)
            for i in range(0, len(past) if past.any() else 0, block):
                p = past[i : i + block]
                packed = _packed(now[i : i + block] - start[i : i + block], p, p > 0)
                yield pa.RecordBatch.from_arrays([pa.array([i // block], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["block", *MESSAGE])

        own = encoded.filter((F.col("part") % rounds) == k).select("ids").coalesce(tasks).mapInArrow(run, fields)
        sums, left = own.withColumn("near", F.spark_partition_id().cast("long")), tasks
        while left > 1:  # FAN_IN to one, so that no group grows with the number of tasks
            left = -(-left // FAN_IN)
            sums = sums.withColumn("near", F.floor(F.col("near") / FAN_IN)).groupBy("near", "block").applyInArrow(_added, f"near long, {fields}")
        weights = weights.copy()
        for row in sums.select("block", *MESSAGE).toArrow().to_pylist():  # all weights once
            change, past, n = _unpacked(*(row[x] for x in MESSAGE))
            n = np.maximum(n, 1)
            settled = past / n
            at = slice(row["block"] * block, (row["block"] + 1) * block)
            weights[at] = np.clip(weights[at] + change / (1 + (n - 1) * settled / (settled + SETTLED))[:, None], -LIMIT, LIMIT)
        shared.unpersist()
    return weights


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probabilities of all texts under a model learned from those where training holds.

    Returns id_col, training, n_tokens, n_known (seen in training), train_tokens, base_score (smoothed unigrams), score (the
    model; at most 0). A null text is an end alone, in training too; rows with a null id, and repeated rows, are counted and scored
    each, and equal texts score alike; without training rows every word is unseen; an empty table gives an empty result; other
    columns are ignored. A very long text is split in one task, then trained on and scored in chunks.
    Words of equal count are ordered by themselves.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(1 << 16)).cast("int").alias("part")
    named = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"), part)
    counts = stash(count_words(named.filter("training").select("text")), "words")
    table, lex = make_lexicon(counts)
    ids, lexicon = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(lex)
    encoded = stash(encode(named, ids, id_col), "ids")
    bits, unknown = lex.bits, len(lex.counts)
    model = spark.sparkContext.broadcast(train(encoded.filter("training"), lexicon, lex.rounds, bits))

    def run(batches):
        lex, tree = lexicon.value, classes_of(lexicon.value)
        base = np.append(lex.base(lex.counts), 0.0)
        for batch in batches:
            for start, ids, lengths in portions(batch, 2):
                p = log10_probabilities(prepare(ids, lengths, unknown + 1), tree, model.value, bits)
                add = lambda x: np.add.reduceat(x, np.cumsum(lengths) - lengths)  # noqa: E731, B023
                same = [c.slice(start, len(lengths)) for c in (batch.column(0), batch.column(1), batch.column(3))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(lengths, pa.int64()), pa.array(add((ids < unknown).astype(np.int64))), pa.array(add(base[ids])), pa.array(add(p))], [id_col, "training", "_row", "n_tokens", "n_known", "base_score", "score"])

    shape = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, training boolean, _row long, n_tokens long, n_known long, base_score double, score double"
    scored = encoded.select(F.col(f"`{id_col}`"), "training", "ids", "_row").mapInArrow(run, shape)
    rest = encoded.select("_row", F.explode("others").alias("o")).select("_row", "o.word", "o.n").join(counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5)
    of = lambda n, v: F.sum(F.col("n") * F.log10(c / F.lit(n + 0.5 * (v + 1))))
    rest = rest.groupBy("_row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known"), of(lex.tokens, lex.distinct).alias("base"), of(lex.rare_tokens, lex.rare_distinct).alias("more"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.join(rest, "_row", "left").select(
        F.col(f"`{id_col}`"), "training", "n_tokens", plus("n_known", "known").alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        plus("base_score", "base").alias("base_score"), plus("score", "more").alias("score"),
    )
