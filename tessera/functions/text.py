"""Text columns: tokens, term frequencies, summaries, intents, feedback signals, identifiers, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K


def words(text: Column) -> Column:
    """Lower-case words of a-z0-9; camel case splits, and so does all else; empty ones, short ones and repeats stay."""
    x = F.lower(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))
    return F.split(F.coalesce(F.regexp_replace(x, "[^a-z0-9]+", " "), F.lit("")), " ")


def is_term(word: Column) -> Column:
    """Whether a word has three characters or more and is no stop word."""
    return (F.length(word) > 2) & ~word.isin(*K.STOP_WORDS)


def tokens(text: Column) -> Column:
    """The terms of a text, repeats included. Where each becomes a row, explode words() and filter by is_term() instead: that is compiled."""
    return F.filter(words(text), is_term)


def summary(content: Column) -> Column:
    """First sentence if it ends within 200 characters, else 197 characters and an ellipsis; null for short contents."""
    dot = F.instr(content, ". ")
    return (
        F.when(content.isNull() | (F.length(content) < 30), None)
        .when((dot > 1) & (dot <= 200), F.substring(content, F.lit(1), dot))
        .when(F.length(content) > 200, F.concat(F.substring(content, 1, 197), F.lit("...")))
        .otherwise(content)
    )


def intent(query: Column, operator: str | None = None) -> Column:
    """Name of the first intent whose pattern occurs, else `general`. Questions may also name the operator of the store."""
    out = F.when(F.lit(False), "")
    for name, pattern, _ in K.INTENTS:
        pattern = pattern.replace("(?:we|i)", f"(?:we|i|{operator.lower()})") if operator else pattern
        out = out.when(F.lower(query).rlike(pattern), name)
    return out.otherwise("general")


def type_boost(name: Column, kind: Column) -> Column:
    """Boost that an intent gives to a node type, 1 where none."""
    out = F.when(F.lit(False), 1.0)
    for intent_name, _, boosts in K.INTENTS:
        for k, boost in boosts.items():
            out = out.when((name == intent_name) & (kind == k), boost)
    return out.otherwise(1.0)


def family_count(text: Column, family: str) -> Column:
    """How many patterns of a feedback family occur in a text."""
    low = F.lower(text)
    return sum((F.when(low.rlike(p), 1).otherwise(0) for p in K.FEEDBACK[family]), F.lit(0))


def opener(text: Column) -> Column:
    """First word in lower case without punctuation."""
    first = F.element_at(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), 1)
    return F.regexp_replace(first, r"[,.:;!?—–-]", "")


def identifier_parts(name: Column) -> Column:
    """Words of a camel, snake, dotted or path identifier, in lower case; acronyms stay whole."""
    x = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]+", " ")), " "), lambda w: F.length(w) > 1)


def sentences(text: Column) -> Column:
    """Sentences by end marks before white space and a capital or digit; common abbreviations do not end one."""
    x = F.regexp_replace(text, r"\b(Mr|Mrs|Ms|Dr|Prof|St|vs|etc|e\.g|i\.e|No|Fig)\.", "$1\u0001")
    parts = F.split(x, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: F.length(s) > 0)


def domain_terms(text: Column) -> Column:
    """Terms that look like names of things: camel and snake case, dotted names, quoted strings and acronyms, in order, each once."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z]+(?:_[a-z0-9]+)+)\b", r"\b([a-z]+(?:\.[a-z]+)+)\b", r"\"([^\"]{3,40})\"", r"\b([A-Z]{2,6})\b")]
    return F.array_distinct(F.flatten(F.array(*found)))
