"""Injection signals: fixed patterns, a saturating score and a verdict."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.lattice import UNTRUSTED, union_in_order
from corvane.functions.text import let

#: Flag, category, severity, pattern; in the order they are tried.
PATTERNS = (
    ("instruction_override", "override", "HIGH", r"\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}\b(?:previous|prior|above|preceding|earlier|all|any)\b[^.\n]{0,20}\b(?:instruction|prompt|command|direction|rule|context)s?\b"),
    ("instruction_override", "override", "MEDIUM", r"\b(?:new|updated|revised|real|actual)\s+(?:instruction|task|prompt|objective)s?\s*:"),
    ("role_manipulation", "role", "HIGH", r"(?:^|\n)\s*(?:system|assistant|developer)\s*:"),
    ("role_manipulation", "role", "MEDIUM", r"\byou\s+are\s+now\b"),
    ("role_manipulation", "role", "MEDIUM", r"\b(?:maintenance|developer|debug|admin|god|jailbreak|dan)\s+mode\b"),
    ("role_manipulation", "role", "LOW", r"\b(?:act\s+as|pretend\s+(?:to\s+be|you))\b"),
    ("exfiltration_pattern", "exfiltration", "HIGH", r"\b(?:forward|send|email|e-mail|leak|exfiltrate|upload|post|transmit|share)\b[^.\n]{0,50}?[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("exfiltration_pattern", "exfiltration", "MEDIUM", r"\b(?:forward|send|email|leak|exfiltrate|upload|transmit)\b[^.\n]{0,30}\ball\s+(?:the\s+|your\s+|my\s+)?(?:files?|emails?|messages?|data|documents?|contacts?|history|secrets?)\b"),
    ("credential_pattern", "credential", "MEDIUM", r"\b(?:api[_\s-]?key|secret[_\s-]?key|access[_\s-]?token|auth[_\s-]?token|password|passwd|bearer\s+token|private[_\s-]?key)\b"),
    ("credential_pattern", "credential", "HIGH", r"\b(?:sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[A-Z0-9]{12,})\b"),
    ("hidden_content", "hidden", "MEDIUM", r"<!--.{0,400}?-->"),
    ("hidden_content", "hidden", "MEDIUM", "[\u200b\u200c\u200d\u200e\u200f\u2060\ufeff]"),
    ("encoded_content", "encoded", "LOW", r"\b[A-Za-z0-9+/]{60,}={0,2}\b"),
)
#: What a match of each pattern cannot do without: one literal of every group, in the folded text.
NEEDS: tuple[tuple[tuple[str, ...], ...], ...] = (
    (("ignore", "disregard", "forget", "override"), ("instruction", "prompt", "command", "direction", "rule", "context")),
    ((":",), ("instruction", "task", "prompt", "objective")),
    ((":",), ("system", "assistant", "developer")),
    (("you",), ("are",), ("now",)),
    (("mode",), ("maintenance", "developer", "debug", "admin", "god", "jailbreak", "dan")),
    (("act", "pretend"),),
    (("@",), ("forward", "send", "email", "e-mail", "leak", "exfiltrate", "upload", "post", "transmit", "share")),
    (("all",), ("forward", "send", "email", "leak", "exfiltrate", "upload", "transmit")),
    (("key", "token", "password", "passwd"),),
    (("sk-", "ghp_", "xox", "akia"),),
    (("<!--",), ("-->",)),
    (("\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\u2060", "\ufeff"),),
    (),
)
ENCODED = 12  # has no literal; a long run of its characters instead
MARKER = r"<</?\s*UNTRUSTED_[^\s>]*\s*>>"
#: A severity's weight, and the verdicts' thresholds.
WEIGHTS = {"LOW": 0.2, "MEDIUM": 0.5, "HIGH": 0.9}
SUSPECT, MALICIOUS = 0.35, 0.75
ESCALATING = ("override", "role", "exfiltration")
SIGNAL = "struct<flag:string,category:string,severity:string,evidence:string>"


def java(pattern: str) -> str:
    """The pattern with Unicode classes and cases, \\n alone ending a line."""
    return "(?iUd)" + pattern.replace(r"\s", r"[\s\x1c-\x1f]") if "[^\\s" not in pattern and "[_\\s" not in pattern else "(?iUd)" + pattern


def tool_patterns(names: tuple[str, ...]) -> tuple[tuple[str, str, str, str], ...]:
    """Signals that a text tries to have one of these tools called."""
    alternatives = "|".join(re.escape(n) for n in names if n)
    if not alternatives:
        return ()
    flag, kind = "tool_invocation_attempt", "tool"
    return (
        (flag, kind, "HIGH", rf"\b(?:use|call|invoke|execute|run|trigger)\s+(?:the\s+)?(?:{alternatives})\b"),
        (flag, kind, "MEDIUM", rf"\b(?:{alternatives})\s*\("),
    )


def snippet(text: Column, limit: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def looks_like_marker(text: Column) -> Column:
    return text.rlike("(?iUd)" + MARKER)


def signals(text: Column, tools: tuple[str, ...] = ()) -> Column:
    """Each pattern's first match and the marker signal, in order.

    A pattern is tried on texts alone that hold the literals it needs: most texts are
    passed over by plain searches.
    """
    return let(text, lambda t: let(folded(t), lambda hay: _signals(t, hay, tools)))


def folded(text: Column) -> Column:
    """``text`` in which every character that equals an ASCII letter without case is that lower-case letter."""
    for odd, plain in ("\u0130i", "\u0131i", "\u017fs", "\u212ak"):
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def possible(hay: Column, need: tuple[tuple[str, ...], ...]) -> Column:
    """Whether the folded text holds one literal of each group."""
    found = F.lit(True)
    for group in need:
        found = found & reduce(or_, [F.contains(hay, F.lit(x)) for x in group])
    return found


def _signals(text: Column, hay: Column, tools: tuple[str, ...]) -> Column:
    called = tool_patterns(tools)
    names = tuple(n.lower() for n in tools if n)
    every = (*PATTERNS, *called)
    may = [possible(hay, n) for n in NEEDS] + [possible(hay, (names,)) for _ in called]
    may[ENCODED] = hay.rlike("(?<![a-z0-9+/])[a-z0-9+/]{60}")
    # every pattern matches at least one character, so one extraction tells match and evidence
    hits = F.array(*[F.when(m, F.regexp_extract(text, f"({java(p[3])})", 1)) for m, p in zip(may, every)])
    kind = lambda k: F.array(*[F.lit(p[k]) for p in every])
    one = lambda e, i: F.when(
        F.length(e) > 0,
        F.struct(F.get(kind(0), i).alias("flag"), F.get(kind(1), i).alias("category"), F.get(kind(2), i).alias("severity"), snippet(e).alias("evidence")),
    )
    note = F.lit("the text imitates the fence that marks outside data")
    mark = F.struct(F.lit("spotlight_marker_present").alias("flag"), F.lit("marker").alias("category"), F.lit("HIGH").alias("severity"), note.alias("evidence"))
    marked = F.when(F.contains(hay, F.lit("untrusted_")) & looks_like_marker(text), mark)
    return F.filter(F.concat(F.transform(hits, one), F.array(marked)), lambda s: s.isNotNull())


def escalate(found: Column) -> Column:
    """``found`` with a composite signal where two escalating categories meet."""
    kinds = F.array_sort(F.array_intersect(F.transform(found, lambda s: s["category"]), F.array(*[F.lit(c) for c in ESCALATING])))
    text = F.concat(F.lit("several kinds of attack in one text: "), F.array_join(kinds, ", "))
    extra = F.struct(F.lit("injection_high_confidence").alias("flag"), F.lit("composite").alias("category"), F.lit("HIGH").alias("severity"), text.alias("evidence"))
    return F.when(F.size(kinds) >= 2, F.concat(found, F.array(extra))).otherwise(found)


def weight(severity: Column) -> Column:
    return F.when(severity == "HIGH", WEIGHTS["HIGH"]).when(severity == "MEDIUM", WEIGHTS["MEDIUM"]).otherwise(WEIGHTS["LOW"])


def score(found: Column) -> Column:
    rest = F.aggregate(found, F.lit(1.0), lambda p, s: p * (F.lit(1.0) - weight(s["severity"])))
    return F.round(F.lit(1.0) - rest, 4)


def verdict(value: Column) -> Column:
    return F.when(value >= MALICIOUS, "malicious").when(value >= SUSPECT, "suspect").otherwise("clean")


def scan(df, text: str = "text", tools: tuple[str, ...] = (), enabled: bool = True):
    """``df`` with signals, flags, score and verdict of its text (empty ones are clean).

    All four are made in one generated row per row, so that no filter or column that
    uses them has the patterns tried again.
    """
    none = F.array().cast(f"array<{SIGNAL}>")
    raw = F.when(F.length(text) > 0, signals(F.col(text), tools)).otherwise(none) if enabled else none
    whole = lambda found, value: F.struct(
        found.alias("signals"), value.alias("score"), verdict(value).alias("verdict"), F.array_distinct(F.transform(found, lambda s: s["flag"])).alias("flags")
    )
    scanned = let(F.coalesce(raw, none), lambda f: let(escalate(f), lambda found: let(score(found), lambda value: whole(found, value))))
    names = [c for c in df.columns if c not in ("signals", "score", "verdict", "flags")]
    return df.select("*", F.explode(F.array(scanned)).alias("_scan")).select(*[F.col(f"`{c}`") for c in names], "_scan.*")


def strict_tier(tier: Column, found: Column) -> Column:
    """The tier after a strict scan: malicious content above the lowest tier falls to it."""
    return F.when((found == "malicious") & (tier > UNTRUSTED), UNTRUSTED).otherwise(tier)


def blocking(flags: Column, blocks: tuple[str, ...]) -> Column:
    return F.array_intersect(flags, F.array(*[F.lit(b) for b in blocks]))


def with_flags(old: Column, new: Column) -> Column:
    return union_in_order(old, new)


def explain(found: Column, value: Column, ruling: Column) -> Column:
    """One line per signal under the verdict and score."""
    line = lambda s: F.concat(F.lit("  - "), s["flag"], F.lit(" ("), s["severity"], F.lit("): "), s["evidence"])
    head = F.concat(F.upper(ruling), F.lit(" score="), F.format_number(value, 2))
    return F.concat_ws("\n", head, F.array_join(F.transform(found, line), "\n"))
