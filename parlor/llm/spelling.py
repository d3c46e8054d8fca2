"""Spelling variants: pairs of words one edit apart, found by composing finite-state machines, and the form that each variant stands for.

The acceptor of a vocabulary is composed with the transducer of one insertion, deletion or replacement and with the acceptor again; what the composition
accepts are the pairs. It is cut by initial states. In a pair whose shorter word has L letters, the edit lies in the second half, and both words have the
first half in common, or in the first half, and they share the rest. So a partition holds the words of L and L + 1 letters that share a prefix and a suffix;
what stands between is the window of the edit, and reading the prefix leads all its words to one initial state. A partition with more than ``most``
words is cut again by the halves of its window; a window of one letter holds no more words than pairs of letters, so the cutting ends. Each task builds the
minimised acceptor of its windows and enumerates what the composition accepts.

Null and empty text: no words. Null key: counts as empty in the hash that misspells. Very long texts: one row at a time. Very long words: like others, without
recursion. Repeated rows: their words count again. Ties of counts: the smallest word. Empty table: no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import is_empty, small_batches, stored

MIN_LETTERS, MIN_COUNT, FACTOR, EVERY = 6, 5, 5, 199
#: Words of a partition that one task composes.
MOST = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of runs of Latin letters, A-Z lower-cased. Of every ``every``-th run (by a checksum of key and run) one letter is left out first."""
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))  # leaving letters out makes no run longer
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    h = F.crc32(F.encode(F.concat("key", F.lit(":"), "run"), "UTF-8"))
    rows = rows.withColumn("h", h).withColumn("at", F.pmod("h", F.length("run")).cast("int"))
    misspelt = F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))
    words = rows.select(F.when(F.col("h") % every == 0, misspelt).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """Minimal acyclic acceptor of distinct words given in ascending order."""

    def __init__(self, words: list[str]):
        self.to: list[dict[str, int]] = [{}]
        self.final = [False]
        self._known: dict[tuple, int] = {}
        self._open: list[tuple[int, str, int]] = []
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(same)
            state = self._open[-1][2] if self._open else 0
            for letter in word[same:]:
                self.to.append({})
                self.final.append(False)
                self.to[state][letter] = len(self.to) - 1
                self._open.append((state, letter, len(self.to) - 1))
                state = len(self.to) - 1
            self.final[state] = True
            last = word
        self._close(0)

    def _close(self, depth: int) -> None:
        """States beyond a depth get no more ways out: equal ones become one."""
        while len(self._open) > depth:
            above, letter, state = self._open.pop()
            self.to[above][letter] = self._known.setdefault((self.final[state], tuple(self.to[state].items())), state)

    def both(self, p: int, q: int) -> list[str]:
        """What is accepted from both states."""
        out, todo = [], [(p, q, "")]
        while todo:
            p, q, read = todo.pop()
            if self.final[p] and self.final[q]:
                out.append(read)
            for letter, x in self.to[p].items():
                y = self.to[q].get(letter)
                if y is not None:
                    todo.append((x, y, read + letter))
        return out

    def one_edit_apart(self) -> Iterator[tuple[str, str, bool]]:
        """Pairs accepted by acceptor, one edit, acceptor, once or more; True: a replaced letter, False: the second word has one more.
        Before the edit both machines are in one state; what follows it depends on the two states alone and is found once for them."""
        known: dict[tuple[int, int], list[str]] = {}
        todo = [(0, "")]
        while todo:
            state, read = todo.pop()
            ways = list(self.to[state].items())
            for i, (letter, x) in enumerate(ways):
                todo.append((x, read + letter))
                for p, other, here in ((state, "", False), *((y, b, True) for b, y in ways[i + 1 :])):
                    rest = known.get((p, x))
                    if rest is None:
                        rest = known[p, x] = self.both(p, x)
                    for r in rest:
                        yield read + other + r, read + letter + r, here


def _compose(batches):
    for batch in batches:
        for row in batch.to_pylist():
            count = {x["middle"]: x["n"] for x in row["words"]}
            least, found = row["window"], set()
            for a, b, same_length in Acceptor(sorted(count)).one_edit_apart():
                if len(a) == least:  # pairs of longer words are those of another partition
                    found.add((a, b))
            whole = lambda x: row["prefix"] + x + row["suffix"]  # noqa: E731,B023
            out = [(whole(a), whole(b), count[b]) for a, b in found] + [(whole(b), whole(a), count[a]) for a, b in found]
            for at in range(0, len(out), 50_000):
                a, b, n = zip(*out[at : at + 50_000])
                yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])


_AT = ["least", "window", "prefix", "suffix"]


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two partitions that its partition is cut into."""
    h, m, own = F.floor(F.col("window") / 2).cast("int"), F.col("window"), F.length("middle")
    part = lambda a, n: F.substring("middle", a, n)
    forward = F.struct((m - h).alias("window"), F.concat("prefix", part(F.lit(1), h)).alias("prefix"), F.col("suffix"), part(h + 1, own).alias("middle"))
    backward = F.struct(h.alias("window"), F.col("prefix"), F.concat(part(own - (m - h) + 1, own), F.col("suffix")).alias("suffix"), part(F.lit(1), own - (m - h)).alias("middle"))
    return rows.withColumn("p", F.explode(F.array(forward, backward))).select("least", "p.window", "p.prefix", "p.suffix", "p.middle", "n")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n) of all ordered pairs one edit apart of distinct words (word, n) of two letters or more."""
    n = F.length("word")
    whole = words.select(F.explode(F.array(n, n - 1)).alias("least"), F.col("word").alias("middle"), "n").where("least >= 2")
    open_ = stored(_halves(whole.select("least", F.col("least").alias("window"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), "middle", "n")), "windows")
    units = None
    while True:
        large = open_.groupBy(*_AT).agg(F.count("*").alias("rows")).where((F.col("rows") > most) & (F.col("window") > 1)).select(*_AT)
        large = stored(large, "large")
        last = is_empty(large)
        small = open_ if last else open_.join(large, _AT, "left_anti")
        lists = small.groupBy(*_AT).agg(F.collect_list(F.struct("middle", "n")).alias("words")).where(F.size("words") > 1)
        units = lists if units is None else units.unionByName(lists)
        if last:
            return units.mapInArrow(_compose, "word string, near string, near_n long").distinct()
        open_ = stored(_halves(open_.join(large, _AT, "left_semi")), "windows")


def spelling_forms(words: DataFrame, factor: int = FACTOR, most: int = MOST) -> DataFrame:
    """Per word (word, n): form, root, n, n_near, form_n. The form is the near word of largest n if that is ``factor`` times the word's own or more."""
    small_batches(words.sparkSession)
    words = stored(words.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))  # ties: the smallest word
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    good = -F.col("b.less") >= factor * F.col("n")
    forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n"))
    forms = stored(forms, "forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form. Each round doubles the steps taken; each step has ``factor`` times the count, so rounds are few."""
    to = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        to = stored(to, "roots")
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if is_empty(to.join(on, "root", "left_semi")):
            return to
        to = to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return spelling_forms(vocabulary(docs, key, text))
