"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are counted over all texts. Two words one edit apart agree in their first half or
in their second half (by the shorter one's length): the edit lies in one of them. So words
meet by a key (which half, shorter length, the half's text), and keys are dealt to tasks.
A task builds two minimal acyclic automata, one of its words and one of its words
reversed, whose edges carry how many words lie before them, so that a walk's sum is the
word's number (a perfect hash into the task's arrays). Each word of the shorter length walks its
half exactly, forward or backward, and completes with one error: a changed or an inserted
character. What the backward walk finds although the first halves agree, the forward walk
has found already and is dropped, so no pair comes twice.

A word's form is its most frequent near word, if that is at least twice as frequent (ties:
the smaller word). Roots follow forms by pointer doubling: each step at least doubles the
count, so six rounds reach every root.

Scale: counting is a partial aggregate of built-in functions; only words move after it.
Tasks hold about ``SHARD_WORDS`` words. A half that more words share is split in blocks
of that many words, each of which all words of that half are walked through. A word has at
most some 180 near words per character, whatever the corpus.

Defined cases: null texts have no words; a null document id counts as an empty string in
the hash; repeated rows count each time; very long runs are words like others (cut nowhere);
words without a form are their own root; an empty table gives an empty result; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
SHARD_WORDS = 20_000
#: Doublings that reach any root: forms at least double a 64-bit count, so chains have under 64 steps.
ROUNDS = 6


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with word numbers.

    ``edges[s]`` maps a character to (next state, words of ``s`` that come before its words).
    """

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = [False]
        self.edges: list[dict] = [{}]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # the last word's states that may still change: parent, character, state
        last = ""

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                parent, c, state = path.pop()
                mine = (self.final[state], *self.edges[state].items())
                same = known.setdefault(mine, state)
                if same != state:
                    self.edges[parent][c] = same

        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            settle(shared)
            at = path[-1][2] if path else 0
            for c in word[shared:]:
                self.final.append(False)
                self.edges.append({})
                new = len(self.final) - 1
                self.edges[at][c] = new
                path.append((at, c, new))
                at = new
            self.final[at] = True
            last = word
        settle(0)
        self._number()

    def _number(self) -> None:
        below: dict[int, int] = {}
        left = [0]
        while left:
            s = left[-1]
            if s in below:
                left.pop()
                continue
            if todo := [t for t in self.edges[s].values() if t not in below]:
                left.extend(todo)
                continue
            left.pop()
            n = int(self.final[s])
            for c, t in self.edges[s].items():
                self.edges[s][c] = (t, n)
                n += below[t]
            below[s] = n

    def number(self, word: str) -> int | None:
        """The word's place among the sorted words; None if it is none of them."""
        return self._follow(0, 0, word)

    def _follow(self, s: int, n: int, rest: str) -> int | None:
        edges = self.edges
        for c in rest:
            found = edges[s].get(c)
            if found is None:
                return None
            s = found[0]
            n += found[1]
        return n if self.final[s] else None

    def near(self, word: str, exact: int) -> tuple[set[int], set[int]]:
        """Numbers of the words that begin with ``word[:exact]`` and differ behind it by one
        changed, and by one inserted character."""
        edges, changed, longer, s, n = self.edges, set(), set(), 0, 0
        for i in range(len(word) + 1):
            if i >= exact:
                rest, tail = word[i:], word[i + 1 :]
                own = word[i] if i < len(word) else None
                for c, (t, skip) in edges[s].items():
                    if c == own:  # inserting it behind its like, at the next place, gives the same
                        continue
                    if own is not None and (found := self._follow(t, n + skip, tail)) is not None:
                        changed.add(found)
                    if (found := self._follow(t, n + skip, rest)) is not None:
                        longer.add(found)
            if i == len(word) or (found := edges[s].get(word[i])) is None:
                break
            s = found[0]
            n += found[1]
        return changed, longer


def words_of(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """word and n of all runs, after the marked ones have lost a character."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, UPPER.lower())
    runs = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    runs = runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, less).otherwise(F.col("run")).alias("word"))
    return runs.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))


def half_keys(word: Column) -> Column:
    """Of each word: (back, p, key) for the shorter lengths p = its own and one less; back: the second half is kept."""
    n, out = F.length(word), []
    for p in (n, n - 1):
        h = F.floor(p / 2).cast("int")
        for back, half in ((False, F.substring(word, F.lit(1), h)), (True, F.right(word, p - h))):
            out.append(F.struct(F.lit(back).alias("back"), p.alias("p"), F.xxhash64(F.lit(back), p, half).alias("key")))
    return F.array(*out)


def _walk(group: pa.Table) -> pa.Table:
    """The near pairs (word, other, n of the other) that one task's automata find.

    A task holds several halves and blocks, so what a walk meets must be stored for the
    same half and block: elsewhere another walk finds it.
    """
    out: tuple[list, list, list] = ([], [], [])
    columns = [group.column(c).to_pylist() for c in ("back", "p", "key", "block", "word", "n", "stored")]
    for back in (False, True):
        rows = [(p, key, block, w[::-1] if back else w, n, stored) for b, p, key, block, w, n, stored in zip(*columns) if b == back]
        counts = {w: n for _, _, _, w, n, stored in rows if stored}
        here = {(key, block, w) for _, key, block, w, _, stored in rows if stored}
        names = sorted(counts)
        automaton = Automaton(names)
        for p, key, block, word, n, _ in rows:
            if p != len(word):
                continue
            h = p // 2
            for same_length, found in zip((True, False), automaton.near(word, p - h if back else h)):
                for other in map(names.__getitem__, found):
                    plain, its = (word[::-1], other[::-1]) if back else (word, other)
                    if (back and plain[:h] == its[:h]) or (key, block, other) not in here:
                        continue
                    for values, value in zip(out, (plain, its, counts[other])):
                        values.append(value)
                    if not same_length:
                        for values, value in zip(out, (its, plain, n)):
                            values.append(value)
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "other", "other_n"])


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, other, other_n: each ordered pair of words one edit apart, once."""
    keyed = words.select("word", "n", F.explode(half_keys(F.col("word"))).alias("k")).select("word", "n", "k.*")
    hot = keyed.groupBy("key").count().where(F.col("count") > shard_words)
    hot = hot.select("key", F.ceil(F.col("count") / shard_words).cast("int").alias("blocks"))
    rows = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    walks = F.col("p") == F.length("word")
    blocks = F.when(walks, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    rows = rows.withColumn("own", own).select("*", F.explode(blocks).alias("block")).withColumn("stored", F.col("own") == F.col("block"))
    n_shards = max(1, -(-4 * words.count() // shard_words))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "block"), F.lit(n_shards)))
    rows = rows.select("shard", "back", "p", "key", "block", "word", "n", "stored")
    return rows.groupBy("shard").applyInArrow(_walk, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words (word, form) that have a form, by pointer doubling."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(ROUNDS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = cut(at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").limit(1).count() == 0:
            break
        at = at.drop("moved")
    return at.select("word", "root")


def group(
    docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of enough characters and occurrences."""
    words = cut(words_of(docs, id_col, text_col, min_chars).where(F.col("n") >= min_count), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = near_pairs(words, shard_words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word", "left")
    led = -F.col("best.n") >= ratio * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best.word")).alias("form"), F.when(led, -F.col("best.n")).alias("form_n")), "spelling-forms")
    found = roots(rows.where("form is not null"))
    return rows.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
