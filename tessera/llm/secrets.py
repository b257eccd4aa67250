"""Spans of secrets in whole texts: three fixed patterns, and a token-efficiency test for random strings.

The test takes runs of key-like characters and asks how many characters a token of a byte-level BPE vocabulary covers.
Words and identifiers are made of frequent pieces and give long tokens; random strings break into short ones. The ratio that
counts as low falls with the length of a run.
Known shapes that are random but no secrets (digests in hex, UUIDs, dotted versions, identifiers made of words) are excluded.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is what [0-9a-f]+ finds there
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Candidates of the efficiency test: runs of so many key characters that hold letters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Most characters a token of a random run, by the least length that it goes for: shorter runs scatter more, so they must be less efficient. Letters
#: of one case, capitalised or not, look like words and are judged from PLAIN characters on.
RATIOS = ((20, 2.0), (16, 1.85), (12, 1.75))
PLAIN = 24
WORDLIKE = re.compile(r"[A-Z]?[a-z]+\Z|[A-Z]+\Z")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
HEX_ONLY = re.compile(r"[0-9a-fA-F]+\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: An identifier: words of one case or capitalised, joined by _ - / and perhaps numbered.
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|\d{1,4})(?:[_/-]+(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|\d{1,4}))*[_/=-]*\Z")
#: The split pattern of byte-level BPE tokenizers of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and without overlaps inside a kind."""
    out = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_random(run: str, encoding: tiktoken.Encoding, ratios=RATIOS) -> bool:
    """Whether the vocabulary covers this run with few characters a token, and it has no known shape."""
    if WORDLIKE.match(run):
        if len(run) < PLAIN:
            return False
    elif not any(map(str.isalpha, run)) or IDENTIFIER.match(run):
        return False
    if UUID.match(run) or len(run) in DIGEST_LENGTHS and HEX_ONLY.match(run):
        return False
    most = next((r for n, r in ratios if len(run) >= n), 0.0)
    return len(run) <= most * len(encoding.encode_ordinary(run))


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding: tiktoken.Encoding, ratios=RATIOS) -> list[tuple[int, int, int]]:
    """Random runs in what the taken spans leave of the text; of a run that they cut, each rest is judged by itself. taken: by start."""
    if taken:
        left, at = [], 0
        for s, _, e in taken:
            left += [text[at:s], " " * (e - max(at, s))]
            at = max(at, e)
        text = "".join(left) + text[at:]
    return [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if is_random(m[0], encoding, ratios)]


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, vocabulary_path: str, ratios=RATIOS, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """Secret spans of every text, in code points, end exclusive.

    Returns id_col, n_assign, n_access, n_hex, n_random, base_sha256 (of the base spans joined as kind:start:end by
    start, then kind), spans (all, joined likewise) and, if asked for, redacted (the text with each span, overlapping ones together,
    as `[SECRET]`). Spans of one start are in the order of their kinds; what base spans leave of a run of key characters is judged like a run of its own, if it has as many characters.
    A null text counts as empty; repeated rows and null ids each give their row; other columns are ignored. A very long
    text is scanned whole in one task, in time that grows with its length and its spans.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        encoding = vocabulary(vocabulary_path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, base, encoding, ratios))
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(spans), *([redact(text, spans)] if redacted else [])))
            kinds = [pa.int64()] * 4 + [pa.string()] * (len(names) - 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    names = [id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", *["redacted"] * redacted]
    shape = f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string{', redacted string' * redacted}"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(scan, shape)


def redact(text: str, spans) -> str:
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, vocabulary_path: str, ratios=RATIOS, text_col: str = "text") -> DataFrame:
    """docs with each secret span replaced by `[SECRET]`; all columns, in their order; null texts stay null, empty ones empty, repeated rows alike."""

    def scan(batches):
        encoding = vocabulary(vocabulary_path)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    if spans := base + random_spans(text, base, encoding, ratios):
                        text = redact(text, spans)
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], ["_text", "_rest"])

    slim = docs.select(F.col(text_col).cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_rest"))
    done = slim.mapInArrow(scan, slim.schema)
    return done.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`") for c in docs.columns])
