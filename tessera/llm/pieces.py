"""SentencePiece BPE encoding and decoding of whole texts by a table of merge-type prefixes.

The model file (a parameter; it must exist on every executor) gives pieces and scores. Every prefix of a text has an encoding of its own, and of that
the table keeps the last token alone. An automaton over all pieces yields those that end at a place; the one that counts is the one that may stand
after the last token of the prefix before it, which a test of the pair decides: two tokens may be neighbours if merging their joint characters gives just
these two. There is one such token for each place, so the ids of the whole text are read off from its end backwards, in time that is linear in its length.

Texts are cut where no piece of the model reaches across: before spaces that follow something else, between letters and ASCII signs that no piece
joins, and at ASCII characters that no piece holds. The parts are tabled by themselves, and short ones are remembered, up to a bound.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from itertools import groupby

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a space in pieces (fixed value).
SPACE = "▁"
#: Parts of at most so many characters are remembered, so many of them in each of two generations; pairs of tokens, too.
SHORT, PARTS, PAIRS = 48, 1 << 18, 1 << 20
LETTER = re.compile(r"[^\W\d_]")


class Pieces:
    """A model whose merges are tabled: BPE with byte fallback, without normalisation but for spaces."""

    def __init__(self, path: str):
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = processor.get_piece_size()
        # a plain model turns spaces into marks, puts one mark before the text, and changes nothing else
        if processor.encode(" ﬁ  x ", out_type=str)[0][0] != SPACE or processor.decode(processor.encode(" ﬁ  x ")) != " ﬁ  x " or processor.encode(""):
            raise ValueError("only models without normalisation, with a space before the text, are handled")
        self.bytes_at = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(processor.is_byte, self.bytes_at)) or any(processor.is_unused(i) for i in range(n)):
            raise ValueError("only models with byte fallback and without unused pieces are handled")
        own = [i for i in range(n) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
        self.piece = {i: processor.id_to_piece(i) for i in own}
        self.id_of = {p: i for i, p in self.piece.items()}
        self.score = {p: processor.get_score(i) for p, i in self.id_of.items()}
        if not all(c in self.id_of for p in self.id_of for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.size = {i: len(p) for i, p in self.piece.items()}
        self.surface = {i: p.replace(SPACE, " ") for i, p in self.piece.items()}
        self.decimal = {i: str(i) for i in range(n)}
        self.byte_of = {i: b for b, i in enumerate(self.bytes_at)}
        self.part = self.part_pattern()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self.merged(p) == [p]:  # a piece that merging never makes is no last token of anything
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def part_pattern(self) -> re.Pattern:
        """What to cut texts into: no piece reaches from one part into the next."""
        inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        if any(x[0] != SPACE and x[1] == SPACE for x in inside):
            return re.compile("(?s).+")
        missing = {chr(c) for c in range(128) if chr(c) not in self.id_of}
        signs = {chr(c) for c in range(128) if not LETTER.match(chr(c))} - missing
        none, sign = ("".join(map(re.escape, sorted(x))) for x in (missing, signs))
        none, whole = none or "\0", f"{SPACE}*[^{SPACE}{none}]+|{SPACE}+|[{none}]"
        if any((x[0] in signs and LETTER.match(x[1])) or (x[1] in signs and LETTER.match(x[0])) for x in inside):
            return re.compile(whole)
        other = rf"(?![^\w{sign}{SPACE}{none}]|\d|_)"  # characters that might be joined to letters as well as signs
        return re.compile(f"{SPACE}*{LETTER.pattern}++{other}|{SPACE}*[{sign}]++{other}|{whole}")

    def merged(self, text: str) -> list[str]:
        """Merge neighbours of best score, the leftmost of these first, until none is a piece: what the pair test stands on."""
        part, score = list(text), self.score
        before, after = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap = [(-score[p], i, p) for i in range(len(part) - 1) if (p := part[i] + part[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j < 0 or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (q := part[a] + part[b]) in score:
                    heapq.heappush(heap, (-score[q], a, q))
        return [p for p in part if p]

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left in an encoding."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.piece[left], self.piece[right]
        found = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return found

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part: the last token of each of its prefixes, then backwards from the end; 0 marks characters that are no pieces."""
        last, known = [0] * (len(part) + 1) if len(part) <= SHORT else array("i", bytes(4 * (len(part) + 1))), self.pairs.get
        for end, (token, size) in self.automaton.iter(part):
            if not last[end + 1]:
                before = last[end + 1 - size]
                if before:
                    fits = known(before << 32 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if not fits:
                        continue
                last[end + 1] = token
        out, at = [], len(part)
        while at:
            token = last[at]
            if token:
                out.append(token)
                at -= self.size[token]
            else:
                at -= 1
                out += [self.bytes_at[b] for b in reversed(part[at].encode())]
        out.reverse()
        return out

    def remembered(self, part: str) -> tuple[str, str]:
        """Ids of a part in decimal, joined by commas, and what they decode to."""
        found = self.parts.get(part)
        if found is None:
            found = self.older.get(part)
            if found is None:
                ids = self.encode_part(part)
                found = ",".join([self.decimal[i] for i in ids]), self.surfaces(ids)
                if len(part) > SHORT:
                    return found
            if len(self.parts) >= PARTS:
                self.parts, self.older = {}, self.parts
            self.parts[part] = found
        return found

    def cut(self, text: str) -> list[str]:
        return self.part.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for p in self.cut(text) for i in self.encode_part(p)]

    def surfaces(self, ids) -> str:
        """What ids stand for, with the space before the text; runs of byte tokens are UTF-8, each byte outside a valid sequence U+FFFD."""
        try:
            return "".join([self.surface[i] for i in ids])
        except KeyError:
            return "".join(_utf8(bytes(self.byte_of[i] for i in run)) if raw else "".join([self.surface[i] for i in run]) for raw, run in groupby(ids, self.byte_of.__contains__))

    def decode(self, ids) -> str:
        return self.surfaces(ids).removeprefix(" ")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of what they decode to."""
        get = self.parts.get
        found = [get(p) or self.remembered(p) for p in self.cut(text)]
        decimal, decoded = ",".join([x[0] for x in found]), "".join([x[1] for x in found]).removeprefix(" ")
        return decimal.count(",") + bool(decimal), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError as e:
        return run[: e.start].decode() + "�" + _utf8(run[e.start + 1 :])


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


OUTPUTS = {"count": "n_tokens long", "ids": "ids array<int>", "text": "decoded string", "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string"}


def encode_decode(docs: DataFrame, path: str, outputs=("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, without begin and end ids, and decode the ids again.

    outputs: of `count` (n_tokens), `ids`, `text` (decoded) and `digests` (n_tokens, SHA-256 of the comma-joined ids and of the decoded text).
    A mark of a space in a text decodes as a space, as in the sentencepiece library; names of control tokens in a text are plain text. A null text counts
    as empty (no ids, empty decoded text); ids that are null or repeated give one result a row; an empty table gives an empty result; other columns are
    ignored. A very long text is encoded whole, in one task, in linear time.
    """
    outputs = [k for k in OUTPUTS if k in outputs]
    id_type = docs.schema[id_col].dataType.simpleString()
    shape = ", ".join(OUTPUTS[k] for k in outputs)
    names = [x.split()[0] for x in shape.split(", ")]

    def read(batches):
        model = pieces(path)
        for batch in batches:
            texts, columns = [t or "" for t in batch.column(1).to_pylist()], [batch.column(0)]
            if "digests" in outputs:
                rows = list(map(model.digests, texts))
            if {"count", "ids", "text"} & {*outputs}:
                ids = list(map(model.encode, texts))
            for kind in outputs:
                if kind == "count":
                    columns.append(pa.array(list(map(len, ids)), pa.int64()))
                elif kind == "ids":
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                elif kind == "text":
                    columns.append(pa.array(list(map(model.decode, ids)), pa.string()))
                else:
                    columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *names])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(read, f"`{id_col}` {id_type}, {shape}")
