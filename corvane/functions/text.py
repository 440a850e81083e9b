"""Text kernels: stripping, tokens, stems, matching form, leaf texts."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the matching rules see it (Unicode, and the four separators Java's class lacks).
SPACE = "[\\s\\x1c-\\x1f]"
#: Words that carry no signal.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "its", "of", "on", "or",
    "that", "the", "to", "was", "were", "will", "with", "this", "these", "those", "there",
)
_STOPPED = frozenset(STOPWORDS)
#: Suffix, replacement, shortest stem; in the order they are tried.
SUFFIXES = (("ies", "y", 1), ("sses", "ss", 1), ("ing", "", 3), ("ed", "", 3), ("es", "", 2), ("s", "", 2))
CHARS_PER_TOKEN = 4
DATAMARK = "\ue000"
#: Characters removed before texts are matched.
INVISIBLE = "\u200b\ufeff\u00ad"
MIN_STRING_MATCH, MIN_SCALAR_MATCH = 4, 8


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("int")


def stem(token: Column) -> Column:
    """The first suffix that fits decides; one whose stem is too short lets the next try."""
    out = F.when((F.length(token) <= 3) | token.rlike("[0-9]$"), token)
    for suffix, new, least in SUFFIXES:
        fits = token.endswith(suffix) & (F.length(token) - len(suffix) >= least)
        if suffix == "s":
            fits = fits & ~token.endswith("ss")
        out = out.when(fits, F.concat(F.substring(token, F.lit(1), F.length(token) - len(suffix)), F.lit(new)))
    return out.otherwise(token)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def tokenize(text: Column, drop_stopwords: bool = True, stems: bool = True) -> Column:
    out = words(text)
    if drop_stopwords:
        out = F.filter(out, lambda w: ~w.isin(*STOPWORDS))
    return F.transform(out, stem) if stems else out


def term_of(word: str) -> str | None:
    """What ``tokenize`` makes of one word; None if it drops it."""
    if not word or word in _STOPPED:
        return None
    if len(word) > 3 and word[-1] not in "0123456789":
        for suffix, new, least in SUFFIXES:
            if word.endswith(suffix) and len(word) - len(suffix) >= least and not (suffix == "s" and word.endswith("ss")):
                return word[: -len(suffix)] + new
    return word


#: Bytes of UTF-8 that stand in words; others, those of characters beyond ASCII too, become spaces.
_WORD_BYTES = np.array([b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256)], np.uint8)


def terms_of(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens ``tokenize`` finds in lower-cased texts without nulls, for use inside tasks: the text's place
    and the number of the term of each token, in order, and the terms. Each distinct word is stemmed once."""
    offsets = np.frombuffer(lowered.buffers()[1], np.int32)[lowered.offset :][: len(lowered) + 1]
    held = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    spaced = pa.StringArray.from_buffers(len(lowered), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_WORD_BYTES[held]))
    parts = pc.ascii_split_whitespace(spaced)
    place, words = pc.list_parent_indices(parts).to_numpy(), parts.flatten().dictionary_encode()
    numbers: dict[str, int] = {}
    made = [-1 if (t := term_of(w)) is None else numbers.setdefault(t, len(numbers)) for w in words.dictionary.to_pylist()]
    codes = np.array(made, np.int64)[words.indices.to_numpy()]
    return place[codes >= 0], codes[codes >= 0], pa.array(list(numbers), pa.string())


def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """What case folding changes: characters that become one other, and those that become several."""
    changed = [(c, c.casefold()) for c in map(chr, range(0x110000)) if c.casefold() != c]
    one = [(c, to) for c, to in changed if len(to) == 1]
    return "".join(c for c, _ in one), "".join(to for _, to in one), [(c, to) for c, to in changed if len(to) > 1]


_ONE, _TO, _MANY = _foldings()


def casefold(text: Column) -> Column:
    """Unicode's full case folding. Every text is translated; only those that hold a character
    that becomes several (ß, ligatures) pass through the replacements as well."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(to).alias("to")) for c, to in _MANY])
    spread = F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["c"], p["to"]))
    several = text.rlike("[" + "".join(c for c, _ in _MANY) + "]")
    return F.when(text.rlike("^[\\x00-\\x7f]*\\z"), F.lower(text)).otherwise(F.translate(F.when(several, spread).otherwise(text), _ONE, _TO))


def normalise(text: Column) -> Column:
    """The form in which arguments and tool outputs are compared."""
    plain = F.translate(F.translate(text, DATAMARK, " "), INVISIBLE, "")
    return casefold(strip(F.regexp_replace(plain, f"(?U){SPACE}+", " ")))


def needles(leaves: Column) -> Column:
    """The matching forms of an argument's leaf texts that are long enough to identify."""
    return F.filter(F.transform(leaves, normalise), lambda n: F.length(n) >= MIN_STRING_MATCH)


class _Number(float):
    """A JSON number that is written as it was read."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self


def leaves_of(value: object) -> list[str]:
    """Every scalar in a JSON value, in order: strings as they are, others (as JSON writes
    them) if they are long enough to identify; containers to any depth."""
    out, left = [], [value]
    while left:
        x = left.pop()
        if isinstance(x, dict):
            left.extend(reversed(x.values()))
        elif isinstance(x, list):
            left.extend(reversed(x))
        elif isinstance(x, str):
            out.append(x)
        elif x is not None and len(shown := x.text if isinstance(x, _Number) else json.dumps(x)) >= MIN_SCALAR_MATCH:
            out.append(shown)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_leaves(value: pd.Series) -> pd.Series:
    """``leaves_of`` JSON texts; a text that is no JSON is one string, null has no leaf."""

    def one(text: str | None) -> list[str]:
        if text is None:
            return []
        try:
            return leaves_of(json.loads(text, parse_int=_Number, parse_float=_Number))
        except (ValueError, RecursionError):
            return [text]

    return value.map(one, na_action=None)


@F.pandas_udf(T.StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """JSON texts with sorted keys and no spaces, so that equal arguments are equal texts."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    return value.map(one, na_action=None)


def subtract_own_args(error: Column, leaves: Column) -> Column:
    """``error`` with the call's own argument texts blanked out."""
    long = F.filter(leaves, lambda x: F.length(x) >= MIN_STRING_MATCH)
    return F.aggregate(long, error, lambda acc, x: F.replace(acc, x, F.lit(" ")))
