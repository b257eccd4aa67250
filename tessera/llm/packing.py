"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into full sequences and a rest; nothing is dropped. Pieces are dealt by
a hash to groups of about equal size, each packed by itself: longest piece first, into the open sequence that it leaves
the least room in. Where none has room, a new one is opened, of the length whose cost for each token that it can be
expected to hold is least; the expectation fills it greedily with the pieces still to come. In the end every sequence is cut
down to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import stash

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence: its length, and so much for each one.
OVERHEAD = 32
#: Pieces that are packed together.
GROUP = 20_000
#: Copies of a row that one task makes at once.
RANGE = 65_536


class _Left:
    """Counts of the pieces still to come, by length, with the next smaller length that occurs."""

    def __init__(self, lengths: np.ndarray):
        self.sizes, counts = np.unique(lengths, return_counts=True)
        self.sizes, self.counts = self.sizes.tolist(), counts.tolist()

    def take(self, length: int) -> None:
        i = bisect.bisect_left(self.sizes, length)
        self.counts[i] -= 1
        if not self.counts[i]:
            del self.sizes[i], self.counts[i]

    def fill(self, room: int) -> int:
        """Tokens that a greedy fill, longest first, puts into this room."""
        total, i = 0, bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and room >= self.sizes[0]:
            n = min(self.counts[i], room // self.sizes[i])
            total, room = total + n * self.sizes[i], room - n * self.sizes[i]
            i = min(i - 1, bisect.bisect_right(self.sizes, room) - 1)
        return total


def pack(pieces: list[int], lengths=LENGTHS, overhead: float = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Sequence number, offset in it, and its final length, for each piece (1 to max(lengths) tokens)."""
    lengths = sorted(lengths)
    left = _Left(np.asarray(pieces, np.int64))
    bins, offsets, filled, opened = [0] * len(pieces), [0] * len(pieces), [], []
    rooms: list[int] = []  # rooms that open sequences have, ascending, each once
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(pieces)), key=lambda j: -pieces[j]):
        size = pieces[i]
        left.take(size)
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            b = len(filled)
            fit = [n for n in lengths if n >= size]
            room = min(fit, key=lambda n: ((n + overhead) / (size + left.fill(n - size)), n))
            filled.append(0)
            opened.append(room)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        room -= size
        if room:
            if room not in by_room:
                bisect.insort(rooms, room)
            by_room.setdefault(room, []).append(b)
    final = [lengths[bisect.bisect_left(lengths, n)] for n in filled]
    return bins, offsets, [final[b] for b in bins]


def pack_documents(docs: DataFrame, tokenizer_path: str, lengths=LENGTHS, overhead: float = OVERHEAD, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of all documents in sequences; a document takes its tokens and one end token.

    Returns id_col, copy (number among rows of equal id and length), n_tokens (with the end), piece, start (in the document),
    length, sequence (long), offset (in the sequence), capacity. A null or empty text is an end token alone; null ids and repeated
    rows are packed like any others; a very long text becomes many pieces, dealt to any groups; pieces of equal length are taken by
    id, copy and piece; an empty table gives an empty result; other columns are ignored.
    """
    longest = max(lengths)
    counts = stash(bpe.encode_decode(docs, tokenizer_path, ("count",), id_col, text_col).select(id_col, (F.col("n_tokens") + 1).alias("n_tokens")), "lengths")
    kinds = counts.groupBy(id_col, "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    groups = max(1, math.ceil(counts.select(F.coalesce(F.sum(F.ceil(F.col("n_tokens") / longest)), F.lit(0)).alias("n")).first().n / group))
    # A row that is repeated very often becomes ranges of copies first, dealt out, so that no task makes all of its rows.
    ranges = kinds.select(id_col, "n_tokens", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RANGE).cast("long"))).alias("from")).repartition(id_col, "from")
    rows = ranges.select(id_col, "n_tokens", F.explode(F.sequence("from", F.least(F.col("from") + RANGE, F.col("copies")) - 1)).alias("copy"))
    pieces = rows.select(id_col, "copy", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n_tokens") - 1, F.lit(longest).cast("long")))).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * longest).withColumn("length", F.least(F.lit(longest).cast("long"), F.col("n_tokens") - F.col("start")))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64(id_col, "copy", "piece"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bins, offsets, capacity = pack(table.column("length").to_pylist(), lengths, overhead)
        number = np.asarray(bins, np.int64) + (np.asarray(table.column("group").to_pylist(), np.int64) << 32)
        return table.drop_columns("group").append_column("sequence", pa.array(number, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).append_column("capacity", pa.array(capacity, pa.int64()))

    shape = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, copy long, n_tokens long, piece long, start long, length long, sequence long, offset long, capacity long"
    return pieces.groupBy("group").applyInArrow(run, shape)
