"""Byte-level BPE encoding and decoding of whole texts, with tree concatenation for long unsplit text.

The tokenizer file (a parameter; it must exist on every executor) gives vocabulary, merges and special tokens. A text is
encoded where it is read. A stretch that the split pattern leaves whole for LONG characters or more is cut into leaves, whose encodings are
concatenated as a tree: around each join a window of tokens is encoded again and grown until its first and last token are those
that the halves have there. A BPE encoding is right exactly if each two neighbouring tokens are the encoding of their
joint bytes, so such a join is the encoding of the whole. Texts of more than FAR characters are cut up first, ordinary stretches
at places where the pattern always splits, and all their parts become rows: encoded in parallel, the leaves of a stretch joined level by level by
tasks that take FAN_IN of them each, and in the end put together, which only copies bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tessera.llm.common import stash

#: The split pattern of byte-level BPE tokenizers of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that an unsplit stretch may have to be encoded in one go; bytes of a leaf; tokens of the first window.
LONG, LEAF, WINDOW = 32, 16, 8
#: Characters of a text that is encoded in one task; of a part of a longer one, about; bytes of a leaf there; leaves that one task joins.
FAR, PART, FAR_LEAF, FAN_IN = 262_144, 65_536, 4096, 64
#: Bytes of parts that are sent on at once.
SEND = 4 << 20
SPACE_RUN = re.compile(rf"\s{{{LONG},}}")
#: Before a space that follows something else the pattern always splits, and nothing before it looks further.
SAFE = re.compile(r"(?<=\S)(?= \w)")


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in vocabulary files: itself where printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class Codec:
    def __init__(self, path: str):
        with open(path) as f:
            file = json.load(f)
        split, model = file["pre_tokenizer"], file["model"]
        if split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or file["normalizer"] or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError("only plain byte-level BPE tokenizers are handled")
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.alphabet = byte_alphabet()
        ranks = {bytes(self.alphabet[c] for c in t): i for t, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"]["".join(p)] for p in pairs]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("the ids are not in the order of the merges")
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {a["content"]: a["id"] for a in file["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}

    def plain(self, text: str) -> bool:
        """Whether no stretch of the text is too long to be encoded in one go."""
        words = text.split()
        if not words:
            return len(text) < LONG
        sizes = list(map(len, words))
        return max(sizes) < LONG and (len(text) - sum(sizes) - len(sizes) < LONG - 2 or not SPACE_RUN.search(text))

    def encode_plain(self, text: str) -> list[int]:
        if not self.special_split:
            return self.encoding.encode_ordinary(text)
        parts = self.special_split.split(text)
        if len(parts) == 1:
            return self.encoding.encode_ordinary(text)
        return [i for p in parts if p for i in ([self.special[p]] if p in self.special else self.encoding.encode_ordinary(p))]

    def encode(self, text: str) -> list[int]:
        """Of a text that is encoded in one task."""
        if self.plain(text):
            return self.encode_plain(text)
        out = []
        for stretch, leaves in groupby(self.parts(text, LEAF), lambda p: p[0]):
            leaves = [data for _, data in leaves]
            out += self.concatenate([self.encoding._encode_single_piece(x) for x in leaves]) if stretch >= 0 else [i for x in leaves for i in self.encode_part(stretch, x)]
        return out

    def encode_part(self, stretch: int, data: bytes) -> list[int]:
        return self.encode_plain(data.decode()) if stretch == -1 else [self.special[data.decode()]] if stretch == -2 else self.encoding._encode_single_piece(data)

    def parts(self, text: str, leaf: int) -> Iterator[tuple[int, bytes]]:
        """Cut a text up: (-1, stretch to encode as a text), (-2, special token), or (number, leaf of that unsplit stretch)."""
        number = 0
        for p in self.special_split.split(text) if self.special_split else [text]:
            if p in self.special:
                yield -2, p.encode()
                continue
            for block in self._blocks(p):
                if self.plain(block):
                    yield -1, block.encode()
                    continue
                for piece, _ in self.splitter.pre_tokenize_str(block):
                    data = bytes(self.alphabet[c] for c in piece)
                    for i in range(0, len(data), leaf):
                        yield number, data[i : i + leaf]
                    number += 1

    def _blocks(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            cut = SAFE.search(text, start + PART)
            end = cut.start() if cut else len(text)
            yield text[start:end]
            start = end

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of an unsplit stretch from those of its two parts."""
        w = WINDOW
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            middle = self.encoding._encode_single_piece(b"".join(self.bytes_of[i] for i in (*left[a:], *right[:b])))
            if (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
                return left[:a] + middle + right[b:]
            w *= 2

    def concatenate(self, leaves: list[list[int]]) -> list[int]:
        """The encoding of an unsplit stretch from those of its leaves, by a tree of joins."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _digests(c: Codec, ids) -> tuple[int, str, str]:
    decimal = ",".join(map(c.decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


OUTPUTS = {"count": "n_tokens long", "ids": "ids array<int>", "text": "decoded string", "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string"}


def _columns(c: Codec, outputs, rows: list) -> list[pa.Array]:
    out = []
    if "count" in outputs:
        out.append(pa.array([None if r is None else len(r) for r in rows], pa.int64()))
    if "ids" in outputs:
        out.append(pa.array(rows, pa.list_(pa.int32())))
    if "text" in outputs:
        out.append(pa.array([None if r is None else c.decode(r) for r in rows], pa.string()))
    if "digests" in outputs:
        d = [(None, None, None) if r is None else _digests(c, r) for r in rows]
        out += [pa.array([x[i] for x in d], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
    return out


def encode_decode(docs: DataFrame, path: str, outputs=("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, without added special tokens, and decode the ids again.

    outputs: of `count` (n_tokens), `ids`, `text` (decoded) and `digests` (n_tokens, SHA-256 of the comma-joined ids and of the decoded text).
    Strings of special tokens inside a text become those tokens, as in the tokenizers library. A null text counts as
    empty (no ids, empty decoded text); ids that are null or repeated give one result a row; an empty table gives an empty
    result; other columns are ignored. Very long texts are spread over tasks; a result row holds all that was asked for of its text.
    """
    outputs = [k for k in OUTPUTS if k in outputs]
    id_type = docs.schema[id_col].dataType.simpleString()
    shape = ", ".join(OUTPUTS[k] for k in outputs)
    names = [x.split()[0] for x in shape.split(", ")]
    cut_names = ["_row", "part", "stretch", "leaf", "data"]
    cut_types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def rows_of(c: Codec, key: pa.Array, text: str):
        """The parts of a text as batches of bounded size."""
        name, rows, size, last, leaf = uuid.uuid4().hex, [], 0, -1, 0

        def batch():
            nothing = _columns(c, outputs, [None] * len(rows))
            return pa.RecordBatch.from_arrays([key.take(pa.array([0] * len(rows))), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(cut_types)), *nothing], [id_col, *cut_names, *names])

        for part, (stretch, data) in enumerate(c.parts(text, FAR_LEAF)):
            leaf = leaf + 1 if stretch == last >= 0 else 0
            last = stretch
            rows.append((name, part, stretch, leaf, data))
            size += len(data) + 64
            if size > SEND:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    def read(batches):
        c = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            near = [i for i, t in enumerate(texts) if len(t) <= FAR]
            nothing = [pa.nulls(len(near), t) for t in cut_types]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(near, pa.int64())), *nothing, *_columns(c, outputs, [c.encode(texts[i]) for i in near])], [id_col, *cut_names, *names])
            for i, t in enumerate(texts):
                if len(t) > FAR:
                    yield from rows_of(c, batch.column(0).slice(i, 1), t)

    def encode_parts(batches):
        c = codec(path)
        for batch in batches:
            ids = [np.asarray(c.encode_part(n, x), np.uint32).tobytes() for n, x in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["_row", "part", "stretch", "leaf", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        """Neighbouring parts of one stretch as one."""
        table = table.sort_by("part")
        ids = codec(path).concatenate([np.frombuffer(x, np.uint32).tolist() for x in table.column("ids").to_pylist()])
        return table.slice(0, 1).select(["_row", "part", "stretch", "leaf"]).append_column("ids", pa.array([np.asarray(ids, np.uint32).tobytes()], pa.binary()))

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.uint32).tolist()
        return pa.Table.from_arrays([table.column("_row").combine_chunks()[:1], *_columns(codec(path), outputs, [ids])], names=["_row", *names])

    named = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    first = stash(named.mapInArrow(read, f"`{id_col}` {id_type}, _row string, part int, stretch int, leaf int, data binary, {shape}"), "bpe")
    done, cut = first.filter("_row is null").select(F.col(f"`{id_col}`"), *names), first.filter("_row is not null")
    most = cut.agg(F.max("leaf").alias("leaf")).first().leaf
    if most is None:
        return done
    part_shape = "_row string, part int, stretch int, leaf int, ids binary"
    encoded = stash(cut.select(*cut_names).repartition("_row", "part").mapInArrow(encode_parts, part_shape), "bpe-parts")
    trees = encoded.filter("stretch >= 0")
    while most:
        near = trees.withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("int"))
        trees, most = near.groupBy("_row", "stretch", "leaf").applyInArrow(joined, part_shape), most // FAN_IN
    merged = encoded.filter("stretch < 0").unionByName(trees).groupBy("_row").applyInArrow(whole, f"_row string, {shape}")
    return done.unionByName(cut.filter("part = 0").select(F.col(f"`{id_col}`"), "_row").join(merged, "_row").drop("_row"))
