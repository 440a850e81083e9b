"""Quality rules, line first (native: DataFrame functions only).

Each line of a text is held against punctuation, navigation and boilerplate
rules: too many marks, entries of a menu (on one line or in a run of short ones that
do not end like sentences), and phrases of four languages. Failing lines are removed; a document that loses too much of its text, or
that fails the document-wide base rules, is rejected.

Everything happens inside one row, so there is no shuffle and no skew: the cost of
a document is linear in its length (n log n only for a text with repeated
three-word windows).

Defined cases: a null text counts as a text without words (all counts 0, rejected
as too short) and stays null; an empty text likewise; a very long text is judged whole,
inside one row; repeated rows are judged alike and all returned (nothing depends on
order, so nothing ties); an empty table gives an empty result; columns of the input
that clash with a result column are replaced by it, other columns pass through, whatever
they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import WHITE, WHITE_RUN, free_name

#: Phrases that mark a line as boilerplate, by language (matched in lower case).
PHRASES_BY_LANGUAGE = {
    "en": (
        "all rights reserved", "copyright", "licensed under", "cookie", "privacy policy", "terms of use",
        "terms of service", "click here", "read more", "subscribe", "sign up", "log in", "javascript",
    ),
    "de": (
        "alle rechte vorbehalten", "impressum", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "klicken sie hier",
        "weiterlesen", "mehr erfahren", "newsletter abonnieren", "jetzt anmelden", "einloggen",
    ),
    "fr": (
        "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "cliquez ici",
        "lire la suite", "en savoir plus", "abonnez-vous", "inscrivez-vous", "se connecter",
    ),
    "es": (
        "todos los derechos reservados", "aviso legal", "política de privacidad", "términos de uso", "haga clic aquí", "haz clic aquí",
        "leer más", "suscríbete", "regístrate", "iniciar sesión",
    ),
}
BOILERPLATE = tuple(dict.fromkeys(p for phrases in PHRASES_BY_LANGUAGE.values() for p in phrases))
#: Marks between the entries of a menu, and marks that end a sentence.
NAV_MARKS, TERMINAL = "|•·»›", ".!?…:;,\"'”’)"
#: Marks that prose rarely holds; a line is noise when they abound.
NOISE_MARKS = "#*$%&|<>{}[]\\^~_=+@!"
SYMBOLS = "#*$%&|<>"
#: The phrases as whole words, a plural s allowed.
PHRASES = "(?<![\\p{L}\\p{N}])(?:" + "|".join(BOILERPLATE) + ")s?(?![\\p{L}\\p{N}])"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; shares are in percent.

    Boilerplate phrases fail a line if they make up ``boiler_share`` of its characters, so
    that prose which mentions one stays. A run of at least
    ``menu_run`` lines of at most ``menu_words`` words each that do not end like a sentence
    is a menu.
    """

    min_words: int = 50
    max_repeat_share: int = 50
    noise_share: int = 10
    nav_marks: int = 3
    nav_share: int = 20
    max_lost_share: int = 30
    boiler_share: int = 15
    menu_run: int = 5
    menu_words: int = 3
    menu_chars: int = 40


def n_of(text: Column, marks: str) -> Column:
    """How many characters of ``text`` are among ``marks``."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE_RUN)).otherwise(F.array().cast("array<string>"))


def line_fails(line: Column, rules: QualityRules) -> Column:
    """True for a line with words that any rule rejects."""
    size = F.length(line)
    pipes = n_of(line, NAV_MARKS)
    n_words = F.size(words_of(line))
    noise = n_of(line, NOISE_MARKS) * 100 > size * rules.noise_share
    navigation = (pipes >= rules.nav_marks) & (pipes * 100 >= n_words * rules.nav_share)
    return noise | navigation | (holds_boilerplate(F.lower(line)) & boilerplate_fails(F.lower(line), rules))


def menu_entry(line: Column, rules: QualityRules) -> Column:
    """A few words that do not end like a sentence."""
    trimmed = F.btrim(line, F.lit(WHITE))
    ends = F.lit(TERMINAL).contains(F.right(trimmed, F.lit(1)))
    return (F.length(trimmed) > 0) & (F.length(trimmed) <= rules.menu_chars) & ~ends & (F.size(words_of(trimmed)) <= rules.menu_words)


def in_menu(entries: Column, i: Column, rules: QualityRules) -> Column:
    """Whether line ``i`` is one of a run of menu entries (``entries`` is true for these)."""
    out = F.lit(False)
    for start in range(rules.menu_run):
        run = F.lit(True)
        for k in range(rules.menu_run):
            run = run & F.coalesce(F.get(entries, i - start + k), F.lit(False))
        out = out | run
    return out


def boilerplate_fails(lower: Column, rules: QualityRules) -> Column:
    trimmed = F.btrim(lower, F.lit(WHITE))
    held = F.length(trimmed) - F.length(F.regexp_replace(trimmed, PHRASES, ""))
    size = F.length(trimmed)
    return (held > 0) & (held * 100 >= size * rules.boiler_share)


def holds_boilerplate(lower: Column) -> Column:
    """Whether a phrase's characters occur at all: a cheap test before the whole-word one."""
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | lower.contains(phrase)
    return found


def any_of(marks: str) -> str:
    """A character class of ``marks`` for a regular expression."""
    return "[" + "".join("\\" + m for m in marks) + "]"


def covered(hits: Column) -> Column:
    """How many words three-word windows at the positions ``hits`` cover together."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))


def repeated_words(grams: Column, repeated: Column) -> Column:
    """Words inside three-word windows whose hash is among ``repeated``.

    A few repeated windows are looked up one by one; many are found as neighbours
    among the sorted windows, so that a text of repetitions stays n log n.
    """
    few = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(repeated, g), i)), lambda i: i.isNotNull())
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    many = F.aggregate(
        F.array(placed),
        F.array().cast("array<int>"),
        lambda _, s: F.transform(
            F.filter(s, lambda e, k: (e["g"] == F.get(s, k - 1)["g"]) | (e["g"] == F.get(s, k + 1)["g"])),
            lambda e: e["i"],
        ),
    )
    return covered(F.when(F.size(repeated) <= 32, few).otherwise(many))


def assess(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """``docs`` with counts, verdicts and ``clean_text`` (the text without failing lines).

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    n_lines, n_removed_lines, lost_chars (long), base_failed, kept (boolean) and
    clean_text (string, null for a null text).
    """
    added = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        "n_removed_lines", "lost_chars", "base_failed", "kept", "clean_text",
    ]
    kept = [c for c in docs.columns if c.lower() not in added]
    # the input's columns travel in one struct, so that no name of theirs can meet one of these
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    whole = F.col(f"`{text}`").cast("string")
    step = docs.select(row.alias("_row"), whole.isNotNull().alias("_some"), F.coalesce(whole, F.lit("")).alias("_t"))
    step = step.select("*", words_of(F.col("_t")).alias("_w"), F.split("_t", "\n").alias("_l"))
    n = F.size("_w")
    word = lambda i: F.get(F.col("_w"), i)
    letters = lambda c: F.length(F.translate(c, WHITE, ""))
    suspect = F.col("_t").rlike(any_of(NOISE_MARKS)) | holds_boilerplate(F.lower("_t"))
    step = step.select(
        "*",
        n.cast("long").alias("n_words"),
        F.when(
            n >= 3, F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, word(i + 1), word(i + 2))), F.lit(1), n - 2)
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_g"),
        F.filter("_l", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_full"),
        F.when(suspect, F.transform("_l", lambda x: line_fails(x, rules))).alias("_marked"),
        F.when(F.size("_l") >= rules.menu_run, F.transform("_l", lambda x: menu_entry(x, rules))).alias("_e"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.when(F.col("_t").rlike(any_of(SYMBOLS)), n_of(F.col("_t"), SYMBOLS))
        .otherwise(0)
        .cast("long")
        .alias("n_symbols"),
    )
    menus = F.size(F.filter("_e", lambda e: e)) >= rules.menu_run
    marked = lambda i: F.coalesce(F.get(F.col("_marked"), i), F.lit(False))
    with_menus = F.transform("_e", lambda e, i: marked(i) | (e & in_menu(F.col("_e"), i, rules)))
    step = step.select("*", F.when(menus, with_menus).otherwise(F.col("_marked")).alias("_bad"))
    step = step.select(
        "*",
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array("_g")).alias("_s"),
        F.when(F.exists("_bad", lambda b: b), F.filter("_l", lambda x, i: ~F.get(F.col("_bad"), i))).alias("_stay"),
    )
    step = step.select(
        "*",
        F.array_distinct(F.filter("_s", lambda g, i: g == F.get(F.col("_s"), i + 1))).alias("_r"),
        F.array_join("_stay", "\n").alias("_left"),
    )
    step = step.select(
        "*",
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_r").isNotNull(), repeated_words(F.col("_g"), F.col("_r")))
        .otherwise(0)
        .cast("long")
        .alias("n_repeat_words"),
        F.size("_full").cast("long").alias("n_lines"),
        F.when(F.col("_stay").isNull(), 0)
        .otherwise(F.size("_l") - F.size("_stay"))
        .cast("long")
        .alias("n_removed_lines"),
        F.when(F.col("_stay").isNull(), 0).otherwise(F.col("word_chars") - letters(F.col("_left"))).cast("long").alias("lost_chars"),
        F.when(F.col("_some"), F.coalesce("_left", "_t")).alias("clean_text"),
    )
    step = step.select(
        "*",
        (
            (F.col("n_words") < rules.min_words)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_share)
        ).alias("base_failed"),
    )
    verdict = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_share)
    return step.select(*[F.col(f"_row.`{c}`") for c in kept], *[F.col(c) for c in added if c != "kept"], verdict.alias("kept"))


def keep(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The assessed rows that the rules keep.

    The partition's number stands in the filter, which the optimizer then leaves above
    the assessment instead of repeating the assessment's expressions inside it.
    """
    part = free_name(docs, "part")
    rows = assess(docs, rules, text).withColumn(part, F.spark_partition_id())
    return rows.where(F.col("kept") & (F.col(part) >= 0)).drop(part)
