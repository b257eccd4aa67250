"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint takes, for each bit, the majority over the hashes of its word shingles (of the distinct ones where a
similarity of shingle sets is asked for). A fingerprint has one
or more 64-bit words, cut into segments; it is entered in one table per segment and looks up the Hamming ball of a small
radius around each. Whatever meets in a table is held against the complete distance. Of two neighbours inside a ball only the
one with fewer set bits (or the smaller) looks up the other, which halves each ball.

With one 64-bit word and two 32-bit segments, balls of radius d // 2 and d - d // 2 - 1 find every pair within d bits: a pair
that exceeds both radii exceeds d. Similarity thresholds need wider fingerprints and many more differing bits, where
balls of radius 1 over many segments find pairs with the chance RECALL; segments grow with the logarithm of the number of texts, so
that buckets do not grow, and their number follows. These tables are dealt by the leading bits of a segment: only flips of these
travel, the rest of a ball is looked up inside the task.

Texts with equal fingerprints count as one (so a group of copies costs one entry); with a similarity threshold only those
with equal shingle sets do. What meets under one key is linked
inside the task as a forest, never as all pairs: only connections are needed. Keys with many entries are dealt
to blocks of bounded size, and whatever looks such a key up visits all its blocks.

For a similarity threshold the links are held against the exact Jaccard similarity of the shingle sets at last, so that
only pairs that reach it connect documents. The forests are those of least distances, the likeliest to pass; where links
fail, what the forest joined is compared exactly instead.
"""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fits, free_name, stash, unstash
from tessera.llm.components import components

SEED = 42
#: Entries of a key in one block; probes compared at once.
BLOCK, CHUNK = 4096, 512  # places in a block have twelve bits
#: Shingles of a group in one block of the exact comparison.
BLOCK_SHINGLES = 1 << 18
#: Tables of keys with several blocks are broadcast up to so many rows; each stands for over BLOCK entries.
BROADCAST_ROWS = 200_000
#: Chance with which a pair at a similarity threshold is found; entries of one group of a wide table; entries of one key up to which all pairs are compared at once.
RECALL, GROUP, FEW = 0.99, 65_536, 32
#: Words of a wide fingerprint that distances are measured on.
MEASURED = 4
BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # by byte, highest bit first




class Plan(NamedTuple):
    """words of a fingerprint; its segments (word, first bit, bits, ball radius); the distance up to which it links, over its first words; the similarity that links must have; leading bits that deal a segment's table out."""

    words: int
    segments: tuple[tuple[int, int, int, int], ...]
    distance: int
    similarity: float | None = None
    leading: int = 0

    @property
    def measured(self) -> int:
        return min(self.words, MEASURED)


def within(distance: int) -> Plan:
    """All pairs of 64-bit fingerprints within a distance of 1 to 4 bits."""
    if not 1 <= distance <= 4:
        raise ValueError("balls are enumerated for distances of 1 to 4")
    return Plan(1, ((0, 32, 32, distance // 2), (0, 0, 32, distance - distance // 2 - 1)), distance)


def similar(similarity: float, texts: int = 1 << 20) -> Plan:
    """Fingerprints of shingle sets with this Jaccard similarity or more, for about so many texts.

    Sets of equal size with Jaccard similarity j have cosine 2j / (1 + j) and differ in arccos(cosine) / pi of the bits;
    three standard deviations of 256 bits are added to the distance (55 bits for 0.8), so that pairs at the very threshold are looked at.
    A segment has as many bits as the number of texts and 20 at least, a ball radius 1, and there are so many of them that a pair at the threshold meets with the
    chance RECALL: 25 of 20 bits for 0.8, with which pairs of 0.85 and 0.9 are found with chances of 0.999 and 0.99999. A third text of the same group often links what a pair misses.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    spread = math.sqrt(share * (1 - share) / 256)
    bits = min(32, max(20, math.ceil(math.log2(max(2, texts)))))
    meet = (1 - share) ** bits + bits * share * (1 - share) ** (bits - 1)
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - meet)) if meet < 1 else 1
    each = 64 // bits
    words = max(MEASURED, -(-tables // each))
    leading = min(bits - 8, max(3, math.ceil(math.log2(max(2, texts) / GROUP))))
    return Plan(words, tuple((i // each, bits * (i % each), bits, 1) for i in range(tables)), int(256 * (share + 3 * spread)), similarity, leading)


def _shingles(text: str, shingle: int):
    """The shingles of so many words in their order, repeats included; a shorter text is one, a text without words none."""
    w = text.encode().lower().split()
    return map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) > shingle else [b" ".join(w)] * bool(w)


def _majority(hashes: bytes, words: int) -> tuple[int, ...]:
    """The majority of each bit over hashes of so many 64-bit words, as signed longs; zeros without hashes."""
    if not hashes:
        return (0,) * words
    width = 8 * words
    n = len(hashes) // width
    lanes, offsets, counts = np.frombuffer(hashes, np.uint8).reshape(n, width), np.arange(width) * 256, np.zeros(width * 256, np.int64)
    for i in range(0, n, 65_536):
        counts += np.bincount((lanes[i : i + 65_536] + offsets).ravel(), minlength=width * 256)
    ones = (counts.reshape(width, 256) @ BIT_TABLE).ravel() * 2 > n
    return tuple(np.packbits(ones).view(">i8").tolist())


def shingle_fingerprint(text: str, shingle: int) -> tuple[int, ...]:
    """One-word SimHash over the shingles, repeats counted."""
    return _majority(b"".join([xxhash.xxh64_digest(p, SEED) for p in _shingles(text, shingle)]), 1)


def set_fingerprint(text: str, shingle: int, words: int) -> tuple[int, ...]:
    """A hash of the set of distinct shingles, then its SimHash: texts with equal sets have equal ones, whatever they repeat.

    A shingle's further words are mixed from the two of its 128-bit hash.
    """
    joined = b"".join(sorted({xxhash.xxh3_128_digest(p, SEED) for p in _shingles(text, shingle)}))
    two = np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, 2)
    lanes = np.empty((len(two), words), np.uint64)
    for i in range(words):
        x = two[:, 0] + np.uint64(i) * (two[:, 1] | np.uint64(1))
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        lanes[:, i] = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (xxhash.xxh3_64_intdigest(joined) - (1 << 63), *_majority((lanes ^ lanes >> np.uint64(31)).astype(">u8").tobytes(), words))


def fingerprints(docs: DataFrame, shingle: int, plan: Plan, id_col: str, text_col: str, text_key) -> DataFrame:
    """id_col, text_key (a long column) and f0, f1, ... (long) of every row, with a similarity set_key before these; a null text is as one without words."""
    names = [f"f{i}" for i in range(plan.words)]
    if plan.similarity is not None:
        names.insert(0, "set_key")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fps = [shingle_fingerprint(t or "", shingle) if plan.similarity is None else set_fingerprint(t or "", shingle, plan.words) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([f[i] for f in fps], pa.int64()) for i in range(len(names)))], [id_col, "text_key", *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string"), text_key).mapInArrow(run, f"`{id_col}` {id_type}, text_key long, {', '.join(f'{n} long' for n in names)}")


def _lookups(plan: Plan) -> str:
    """SQL array of (key, probe) structs of a fingerprint: its entries, and the upward part of each ball."""
    out = []
    for number, (word, first, bits, radius) in enumerate(plan.segments):
        value = f"(shiftrightunsigned(f{word}, {first}) & {(1 << bits) - 1}L)"
        key = f"({number << 40}L | {value})"
        out.append(f"array(named_struct('key', {key}, 'probe', 0))")
        for size in range(1, radius + 1):
            masks = "array(" + ", ".join(f"{sum(1 << b for b in c)}L" for c in itertools.combinations(range(bits), size)) + ")"
            up = f"(bit_count({value} ^ m) > bit_count({value}) or bit_count({value} ^ m) = bit_count({value}) and ({value} ^ m) > {value})"
            out.append(f"transform(filter({masks}, m -> {up}), m -> named_struct('key', {key} ^ m, 'probe', 1))")
    return f"concat({', '.join(out)})"


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a and each row of b."""
    apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for i in range(1, a.shape[1]):
        apart += np.bitwise_count(a[:, None, i] ^ b[None, :, i])
    return apart


class _Bucket:
    """Links of one block of one key: entries first, by node, then what looks them up, in any number of portions."""

    def __init__(self, distance: int):
        self.distance, self.waiting, self.nodes, self.links = distance, [], None, []

    def entries(self, nodes, fps) -> None:
        self.waiting.append((nodes, fps))

    def _close(self) -> None:
        """Link the entries by forests of least distances: each group grows by the entry nearest to any of its own."""
        self.nodes, self.fps = (np.concatenate(x) for x in zip(*self.waiting))
        if len(self.nodes) > BLOCK:
            return self._close_by_stars()
        self.roots, left, links = np.arange(len(self.nodes)), np.arange(len(self.nodes)), []
        while len(left) > 1:
            root = at = left[0]
            left = left[1:]
            best = self._from(at, left)
            while len(left) and best[i := int(best.argmin())] >> 24 <= self.distance:
                low, high = int(best[i]) >> 12 & 4095, int(best[i]) & 4095
                at = left[i]
                links.append((self.nodes[low], self.nodes[high]))
                self.roots[at] = root
                left, best = np.delete(left, i), np.delete(best, i)
                best = np.minimum(best, self._from(at, left))
        self.links.append(np.array(links, np.int64).reshape(-1, 2))

    def _from(self, at: int, left: np.ndarray) -> np.ndarray:
        """Distance, lower and higher place of the pairs of one entry, as one number: one order of all pairs, so that different tables choose the same links."""
        return _apart(self.fps[at : at + 1], self.fps[left])[0].astype(np.int64) << 24 | np.minimum(at, left) << 12 | np.maximum(at, left)

    def _close_by_stars(self) -> None:
        """Of very many entries, those within the distance of a first one are its star, and so on with the rest; stars are linked where any of their entries meet."""
        self.roots, left, links = np.zeros(len(self.nodes), np.int64), np.arange(len(self.nodes)), []
        while len(left):
            near = np.concatenate([_apart(self.fps[left[:1]], self.fps[left[i : i + CHUNK * BLOCK]])[0] for i in range(0, len(left), CHUNK * BLOCK)]) <= self.distance
            self.roots[left[near]] = left[0]
            links.append(np.stack([self.nodes[left[near][1:]], np.full(near.sum() - 1, self.nodes[left[0]])], axis=1))
            left = left[~near]
        self.links += links
        if len(links) > 1:
            largest = np.bincount(self.roots).argmax()
            others = np.flatnonzero(self.roots != largest)
            self.probes(self.nodes[others], self.fps[others])

    def probes(self, nodes, fps) -> None:
        """Link each with the nearest entry of every group within the distance."""
        if not self.waiting:
            return
        if self.nodes is None:
            self._close()
        for i in range(0, len(nodes), CHUNK):
            apart = _apart(fps[i : i + CHUNK], self.fps)
            p, t = np.nonzero(apart <= self.distance)
            if len(p):
                order = np.lexsort((apart[p, t], self.roots[t], p))
                p, t = p[order], t[order]
                first = np.concatenate(([True], (p[1:] != p[:-1]) | (self.roots[t[1:]] != self.roots[t[:-1]])))
                self.links.append(np.stack([nodes[i : i + CHUNK][p[first]], self.nodes[t[first]]], axis=1))

    def close(self) -> np.ndarray:
        if self.waiting and self.nodes is None:
            self._close()
        return np.concatenate([np.zeros((0, 2), np.int64), *self.links])


def _link(plan: Plan):
    def batch_of(links):
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

    def run(batches):
        bucket, at = _Bucket(plan.distance), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, probe, node, *fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + plan.words))
            fp = np.stack(fp, axis=1).view(np.uint64)  # bits of negative numbers would be counted as those of their absolute value
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            ends = np.append(starts[1:], len(key))
            # Alone inside a batch, or looking up what no one entered: nothing to link.
            busy = (ends - starts > 1) & (probe[starts] == 0)
            busy[0] = busy[-1] = True
            for s, e in zip(starts[busy].tolist(), ends[busy].tolist()):
                if at != (key[s], block[s]):
                    if len(links := bucket.close()):
                        yield batch_of(links)
                    bucket, at = _Bucket(plan.distance), (key[s], block[s])
                cut = s + int(np.searchsorted(probe[s:e], 1))
                if cut > s:
                    bucket.entries(node[s:cut], fp[s:cut])
                if e > cut:
                    bucket.probes(node[cut:e], fp[cut:e])
        if len(links := bucket.close()):
            yield batch_of(links)

    return run


class _Group:
    """Links of one group of a wide table: entries of one leading part, and others that look up one value here each."""

    def __init__(self, plan: Plan):
        self.plan, self.bits, self.rows = plan, plan.segments[0][2] - plan.leading, []

    def add(self, probe, value, node, fp) -> None:
        self.rows.append((probe, value, node, fp))

    def close(self) -> np.ndarray:
        """Forests of least distances, of crowded keys and of all others together."""
        probe, value, node, fp = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((node, value, probe))
        probe, value, node, fp = probe[order], value[order], node[order], fp[order]
        n = int(np.searchsorted(probe, 1))
        keys, first, sizes = np.unique(value[:n], return_index=True, return_counts=True)
        if not n:
            return np.zeros((0, 2), np.int64)
        asks, wants = [np.arange(n), np.arange(n, len(value))], [value[:n], value[n:]]
        ones = np.bitwise_count(value[:n])
        for b in range(self.bits):
            other = value[:n] ^ (1 << b)
            up = np.flatnonzero(np.bitwise_count(other) > ones)
            asks.append(up)
            wants.append(other[up])
        ask, want = np.concatenate(asks), np.concatenate(wants)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = (keys[at] == want) & ((ask != first[at]) | (sizes[at] > 1))
        ask, at = ask[hit], at[hit]
        few = sizes[at] <= FEW
        found = self._few(ask[few], first[at[few]], sizes[at[few]], fp, value, n)
        links = [np.zeros((0, 2), np.int64)]
        crowd, key = ask[~few], at[~few]
        order = np.argsort(key, kind="stable")
        crowd, key = crowd[order], key[order]
        for k in np.unique(key).tolist():
            bucket, own = _Bucket(self.plan.distance), slice(first[k], first[k] + sizes[k])
            bucket.entries(node[own], fp[own])
            asked = crowd[np.searchsorted(key, k) : np.searchsorted(key, k, "right")]
            asked = asked[(asked < own.start) | (asked >= own.stop)]
            bucket.probes(node[asked], fp[asked])
            links.append(bucket.close())
        return np.concatenate([self._forest(found, node), *links])

    def _few(self, ask, first, sizes, fp, value, n) -> np.ndarray:
        """(distance, asking, found) of pairs within the distance."""
        out = [np.zeros((0, 3), np.int64)]
        step = max(1, CHUNK * CHUNK // FEW)
        for i in range(0, len(ask), step):
            s = sizes[i : i + step]
            a = np.repeat(ask[i : i + step], s)
            b = np.arange(len(a)) + np.repeat(first[i : i + step] - np.cumsum(s) + s, s)
            keep = (a < b) | (a >= n) | (value[a] != value[b])  # equal entries ask each other
            a, b = a[keep], b[keep]
            d = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64)
            near = d <= self.plan.distance
            out.append(np.stack([d[near], a[near], b[near]], axis=1))
        return np.concatenate(out)

    @staticmethod
    def _forest(pairs: np.ndarray, node: np.ndarray) -> np.ndarray:
        root, out = {}, []

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        ends = np.sort(node[pairs[:, 1:]], axis=1)  # one order of all pairs, so that different tables choose the same links
        for _, a, b in pairs[np.lexsort((ends[:, 1], ends[:, 0], pairs[:, 0]))].tolist():
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
                out.append((node[a], node[b]))
        return np.array(out, np.int64).reshape(-1, 2)


def _wide_lookups(plan: Plan) -> str:
    """SQL array of (key, probe, value) structs of a fingerprint: its entry of each table, and what it looks up under other leading bits."""
    out, low = [], plan.segments[0][2] - plan.leading
    for number, (word, first, bits, _) in enumerate(plan.segments):
        value = f"(shiftrightunsigned(f{word}, {first}) & {(1 << bits) - 1}L)"
        struct = lambda v, probe: f"named_struct('key', {number << 40}L | shiftright({v}, {low}), 'probe', {probe}, 'value', {v} & {(1 << low) - 1}L)"
        masks = "array(" + ", ".join(f"{1 << b}L" for b in range(low, bits)) + ")"
        out += [f"array({struct(value, 0)})", f"transform(filter({masks}, m -> ({value} & m) = 0), m -> {struct(f'({value} | m)', 1)})"]
    return f"concat({', '.join(out)})"


def _wide_link(plan: Plan):
    def run(batches):
        group, at = None, None
        for batch in batches:
            key, probe, value, node, *fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + plan.measured))
            fp = np.stack(fp, axis=1).view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
            for s, e in zip(starts, np.append(starts[1:], len(key))):
                if at != key[s]:
                    if group:
                        yield _batch_of(group.close())
                    group, at = _Group(plan), key[s]
                group.add(probe[s:e], value[s:e], node[s:e], fp[s:e])
        if group:
            yield _batch_of(group.close())

    return run


def _batch_of(links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])


def wide_links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """As fingerprint_links, for plans with a similarity. A group holds the entries of one leading part of one table, about GROUP of them."""
    fp = [f"f{i}" for i in range(plan.measured)]
    rows = distinct.select("node", *fp, F.explode(F.expr(_wide_lookups(plan))).alias("x")).select("x.key", "x.probe", "x.value", "node", *fp)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_link(plan), "u long, v long")


def fingerprint_links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """Links (u, v) between nodes (columns node, f0, f1, ...; distinct) that connect what the plan links: a forest of each key's."""
    fp = [f"f{i}" for i in range(plan.words)]
    met = distinct.select("node", *fp, F.explode(F.expr(_lookups(plan))).alias("x")).select("node", *fp, "x.key", "x.probe")
    crowded = met.filter("probe = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    crowded = stash(crowded.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded")
    dealt = met.join(F.broadcast(crowded) if fits(crowded, BROADCAST_ROWS) else crowded, "key", "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # An entry of a crowded key lies in its own block and looks up the others; a probe looks up all.
    visits = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.col("probe").alias("probe")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.when((b == own) & (F.col("probe") == 0), 0).otherwise(1).alias("probe")))
    )
    rows = dealt.select("key", "node", *fp, F.explode(visits).alias("x")).select("key", "x.block", "x.probe", "node", *fp)
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "probe", "node").mapInArrow(_link(plan), "u long, v long")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the distinct hashes of the shingles of each text. texts: node, text."""

    def run(batches):
        for batch in batches:
            sets = []
            for text in batch.column(1).to_pylist():
                hashes = b"".join([xxhash.xxh64_digest(p, SEED) for p in _shingles(text or "", shingle)])
                sets.append(np.unique(np.frombuffer(hashes, ">i8").astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


class _Block:
    """Exact links of one block of a group: its texts first, then texts of other blocks that visit it."""

    def __init__(self, similarity: float):
        self.similarity, self.texts, self.index, self.links = similarity, [], None, []
        self.parent: dict[int, int] = {}

    def _find(self, part: int) -> int:
        while (up := self.parent.get(part, part)) != part:
            part = up
        return part

    def _close(self) -> None:
        self.nodes = np.array([x[0] for x in self.texts], np.int64)
        self.parts = np.array([x[1] for x in self.texts], np.int64)
        self.sizes = np.array([len(x[3]) for x in self.texts], np.int64)
        hashes = np.concatenate([x[3] for x in self.texts])
        order = np.argsort(hashes, kind="stable")
        self.index, self.owners = hashes[order], np.repeat(np.arange(len(self.texts)), self.sizes)[order]
        for node, part, small, shingles in self.texts:
            if small:
                self._look(node, part, shingles)
        self.texts = []

    def _look(self, node: int, part: int, shingles: np.ndarray) -> None:
        """Link with one text of each other part that has a text similar enough."""
        first, end = np.searchsorted(self.index, shingles), np.searchsorted(self.index, shingles, "right")
        counts = end - first
        at = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(shingles) else np.zeros(0, np.int64)
        common = np.bincount(self.owners[at], minlength=len(self.nodes))
        like = np.flatnonzero((common > 0) & (common >= self.similarity * (self.sizes + len(shingles) - common)))
        own = self._find(part)
        parts, where = np.unique(self.parts[like], return_index=True)
        for other, i in zip(parts.tolist(), like[where].tolist()):
            if other != own:
                self.links.append((node, int(self.nodes[i])))
                self.parent[other] = own
                self.parts[self.parts == other] = own

    def add(self, probe: int, node: int, part: int, small: bool, shingles: np.ndarray) -> None:
        if not probe:
            self.texts.append((node, part, small, shingles))
        elif self.texts or self.index is not None:
            if self.index is None:
                self._close()
            self._look(node, part, shingles)

    def close(self) -> list[tuple[int, int]]:
        if self.texts and self.index is None:
            self._close()
        return self.links


def _exact(similarity: float):
    def batch_of(links):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches):
        block, at = _Block(similarity), None
        for batch in batches:
            shingles = batch.column(6)
            names = zip(*(batch.column(i).to_pylist() for i in range(6)))
            for i, (group, number, probe, node, part, small) in enumerate(names):
                if at != (group, number):
                    if links := block.close():
                        yield batch_of(links)
                    block, at = _Block(similarity), (group, number)
                block.add(probe, node, part, small, shingles[i].values.to_numpy(zero_copy_only=False))
        if links := block.close():
            yield batch_of(links)

    return run


def _rooted(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """nodes with the root of their component under the links."""
    roots = components(links).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return nodes.join(roots, F.col("node") == F.col("_node"), "left").withColumn(name, F.coalesce("_root", "node")).drop("_node", "_root")


def similar_links(links: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links of this Jaccard similarity or more of the shingle sets. nodes: node, text_key; texts: text_key, text.

    The given links are checked first. Where one fails between texts that no others connect, their group under all the given links
    may hold similar texts that its forest does not link, so the parts of such a group are compared exactly: every text outside the
    largest part looks up all of the group, which is dealt to blocks of bounded size. Links that join no further parts are not made.
    """
    links = stash(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct().join(nodes, "node").select("node", "text_key")
    ends = stash(ends, "ends")
    met = texts.join(F.broadcast(ends) if fits(ends, BROADCAST_ROWS) else ends, "text_key")
    sets = stash(shingle_sets(met.groupBy("node").agg(F.min("text").alias("text")), shingle), "shingles")
    u, v = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    common = F.size(F.array_intersect("su", "sv"))
    like = common >= similarity * (F.size("su") + F.size("sv") - common)
    checked = stash(links.join(u, "u").join(v, "v").select("u", "v", like.alias("like")), "checked")
    passed = checked.filter("like").select("u", "v")
    if checked.filter("not like").isEmpty():
        return passed
    parts = stash(_rooted(_rooted(ends.select("node"), links, "group"), passed, "part"), "parts")
    split = stash(parts.groupBy("group").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("group"), "split")
    open_parts = parts.join(F.broadcast(split) if fits(split, BROADCAST_ROWS) else split, "group")
    members = stash(open_parts.join(sets, "node").select("group", "part", "node", "shingles"), "members")
    sizes = members.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("shingles"))
    largest = sizes.groupBy("group").agg(F.ceil(F.sum("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.max(F.struct("n", "part")).alias("largest"))
    largest = stash(largest.select("group", F.greatest("blocks", F.lit(1)).alias("blocks"), F.col("largest.part").alias("largest")), "largest")
    dealt = members.join(F.broadcast(largest) if fits(largest, BROADCAST_ROWS) else largest, "group").withColumn("small", F.col("part") != F.col("largest"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    visits = F.when(F.col("small"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    rows = dealt.withColumn("own", own).withColumn("block", F.explode(visits)).select("group", "block", (F.col("block") != F.col("own")).cast("int").alias("probe"), "node", "part", "small", "shingles")
    found = rows.repartition("group", "block").sortWithinPartitions("group", "block", "probe", "node").mapInArrow(_exact(similarity), "u long, v long")
    return passed.unionByName(found)


def near_duplicates(docs: DataFrame, plan: Plan | None = None, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row under the links of a plan, by default those of similarity 0.8 over five-word shingles.

    Returns id_col, f0, f1, ... (the fingerprint), fingerprint (its hex digits), component_id (the smallest id of the
    component; null if all its ids are null). Null and word-free texts have the fingerprint zero and are linked like any
    other; shorter texts are one shingle; a very long text is hashed whole in one task; repeated rows share fingerprint and component; an empty table gives an empty
    result; other columns are ignored. Nodes of wide fingerprints are named by a 64-bit hash of them and of the shingle set.
    """
    plan = plan or similar(0.8, docs.count())
    fp = [f"f{i}" for i in range(plan.words)]
    text_key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key")
    marked = stash(fingerprints(docs, shingle, plan, id_col, text_col, text_key), "fingerprints")
    same = fp if plan.similarity is None else ["set_key", "f0", "f1"]
    node = F.col("f0") if same == ["f0"] else F.xxhash64(*same)
    rest = [F.first(x).alias(x) for x in fp if x not in same]
    nodes = stash(marked.groupBy(*same).agg(F.min(id_col).alias("least"), F.min("text_key").alias("text_key"), *rest).withColumn("node", node), "nodes")
    if plan.similarity is None:
        links = fingerprint_links(nodes.select("node", *fp), plan)
    else:
        links = wide_links(nodes.select("node", *fp), plan)
        links = similar_links(links, nodes, docs.select(text_key, F.col(text_col).cast("string").alias("text")), shingle, plan.similarity)
    roots = components(links).withColumnRenamed("node", "linked")
    rooted = nodes.join(roots, F.col("node") == F.col("linked"), "left").select(*same, "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stash(rooted.join(named, "root").select(*same, "component_id"), "components")
    unstash(nodes)
    digits = F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in fp))
    return marked.join(final, same).select(id_col, *fp, digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, plan: Plan | None = None, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id.

    A document without id cannot be named as a copy and stays; of rows that share the smallest id one stays.
    """
    marked = near_duplicates(docs, plan, shingle, id_col, text_col)
    copy, repeat = free_name(docs, "_copy"), free_name(docs, "_repeated")
    copies = marked.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(copy)).distinct()
    kept = docs.join(copies, F.col(id_col) == F.col(copy), "left_anti")
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(repeat)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(repeat)
    repeated = stash(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    again = F.col(id_col) == F.col(repeat)
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates([id_col]))
