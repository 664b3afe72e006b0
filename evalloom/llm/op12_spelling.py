"""Grouping of spelling variants: words one edit apart, each word's commoner form, and the root that forms lead to.

1. ``vocabulary``: runs of Latin letters with only A-Z lower-cased; words are counted within a partition before the shuffle.
2. ``near_words``: an edit lies in one half of a word and leaves the other intact.  So every word stands in a forward
   sorted dictionary (blocks share a prefix, half as long as the shorter word of a pair) and in a reversed one (blocks
   share the other half as a suffix).  Words of ``c`` letters meet those of ``c`` and ``c + 1`` letters in blocks of
   class ``c``.  Blocks of more than ``BLOCK`` words are subdivided before they are dealt out: what is not yet known to be
   intact is halved again, and one of its halves is intact.  The dictionaries are range-partitioned and each task scans
   its blocks in order, halving on until few words are left, which are verified.  What is left of one letter needs no
   verifying: there the words of equal length are all near each other, and are counted, not listed.  A pair is taken only in the
   block where its common prefix ends, so nothing is counted twice, and what a task finds leaves it as one row a word.
3. ``roots``: forms are followed by doubling, as many rounds as the logarithm of the longest chain.

A form has at least twice its word's count, so chains end.  Ties go to the first word in code-point order.

Defined results: null and empty texts have no words; repeated rows and rows without an identifier (its text is then
empty) count as they stand; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import discard, id_text, materialise, parts, slices, table

_RUNS = re.compile("[a-zÀ-ÿ]+").findall
BLOCK = 2048
FEW = 10


def runs(text: str) -> list[str]:
    """Maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased."""
    return _RUNS(text.encode().lower().decode())


def seen(run: str, start: int, every: int) -> str:
    """The run as it counts: where ``every`` divides the CRC-32 that ``start`` begins, one of its letters is missing."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(df: DataFrame, every: int = 97, letters: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text", most: int = 200_000) -> DataFrame:
    """word, n of all words of at least ``letters`` code points that occur ``least`` times; a partition sends at most ``most`` words at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in slices(batches, 512):
            for ident, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if ident is None else ident}:".encode())
                for word, n in Counter(runs(text or "")).items():
                    found[seen(word, start, every)] += n
                if len(found) > most:
                    yield _counted(found)
                    found = Counter()
        yield _counted(found)

    partial = id_text(df, id_col, text_col).mapInArrow(run, "word string, n long")
    return partial.where(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])


PLACE = ["c", "a", "b", "key"]


def _key() -> Column:
    """What the words of a block share: ``a`` letters from the start, and ``b`` letters from the end, read backwards."""
    return F.expr("concat(left(word, a), '\u0001', reverse(right(word, b)))")


def _placed(rows: DataFrame, places: Column) -> DataFrame:
    """Rows in each of the blocks (c, a, b) of an array."""
    return rows.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.c", "p.a", "p.b").withColumn("key", _key())


def dictionaries(words: DataFrame, letters: int, block: int = BLOCK) -> DataFrame:
    """word, n and its blocks c, a, b, key: first halves of the forward and the reversed dictionary, larger blocks subdivided."""
    first = F.expr(f"flatten(transform(filter(array(length(word), length(word) - 1), c -> c >= {letters}), c -> array(named_struct('c', c, 'a', c div 2, 'b', 0L), named_struct('c', c, 'a', 0L, 'b', c - c div 2))))")
    rest = "(c - a - b)"
    halves = F.expr(f"array(named_struct('c', c, 'a', a + {rest} div 2, 'b', b), named_struct('c', c, 'a', a, 'b', b + {rest} - {rest} div 2))")
    rows, done = _placed(words, first), None
    while True:
        large = materialise(rows.groupBy(*PLACE).count().where((F.col("count") > block) & F.expr(f"{rest} > 1")).drop("count"), "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, PLACE, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = materialise(_placed(rows.join(large, PLACE, "left_semi"), halves), "halved")


class Found:
    """What a task knows of each word: how many near words, and of these the commonest, of equals the first."""

    def __init__(self) -> None:
        self.of: dict[str, list] = {}

    def add(self, word: str, times: int, n: int, near: str) -> None:
        got = self.of.get(word)
        if got is None:
            self.of[word] = [times, n, near]
        else:
            got[0] += times
            if n > got[1] or n == got[1] and near < got[2]:
                got[1], got[2] = n, near

    def batch(self) -> pa.RecordBatch:
        times, n, near = zip(*self.of.values(), strict=True) if self.of else ((), (), ())
        cells = [pa.array(self.of.keys(), pa.string()), pa.array(times, pa.int64()), pa.array(n, pa.int64()), pa.array(near, pa.string())]
        self.of = {}
        return pa.RecordBatch.from_arrays(cells, ["word", "times", "near_n", "near"])


def scan(c: int, a: int, b: int, items: list[tuple[str, int]], found: Found) -> None:
    """Near words among ``items``, of ``c`` and ``c + 1`` letters, that share ``a`` letters at the start and ``b`` at the end."""
    short = [x for x in items if len(x[0]) == c]
    if not short or len(items) < 2:
        return
    rest = c - a - b
    if len(items) <= FEW:
        _verify(c, a, b, short, [x for x in items if len(x[0]) > c], found)
    elif rest <= 1:
        _last(c, a, b, short, [x for x in items if len(x[0]) > c], found)
    else:
        half = rest // 2
        heads, tails = defaultdict(list), defaultdict(list)
        for x in items:
            w = x[0]
            heads[w[a : a + half]].append(x)
            tails[w[len(w) - b - rest + half : len(w) - b]].append(x)
        for group in heads.values():
            scan(c, a + half, b, group, found)
        for group in tails.values():
            scan(c, a, b + rest - half, group, found)


def _verify(c: int, a: int, b: int, short: list[tuple[str, int]], longer: list[tuple[str, int]], found: Found) -> None:
    for i, (u, n) in enumerate(short):
        for v, m in short[i + 1 :] + longer:
            p = a
            while p < c and u[p] == v[p]:
                p += 1
            if (not b or p < c - b) and (u[p + 1 :] if len(v) == c else u[p:]) == v[p + 1 :]:
                found.add(u, 1, m, v)
                found.add(v, 1, n, u)


def _last(c: int, a: int, b: int, short: list[tuple[str, int]], longer: list[tuple[str, int]], found: Found) -> None:
    """One letter is left of the short words, two of the longer: its kind tells all."""
    if len(short) > 1:
        first, second = sorted(short, key=lambda x: (-x[1], x[0]))[:2]
        for x in short:
            near, n = second if x is first else first
            found.add(x[0], len(short) - 1, n, near)
    by = {u[a]: (u, n) for u, n in short}
    for v, m in longer:
        # The longer word has a letter more before the short one's last, or after it where no letter follows.
        for z in {v[a + 1]} - {v[a]} | ({v[a]} if not b else set()):
            if z in by:
                u, n = by[z]
                found.add(u, 1, m, v)
                found.add(v, 1, n, u)


def near_words(placed: DataFrame, most: int = 200_000) -> DataFrame:
    """word, n_near, near_n, near (the commonest near word) of every word that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at, items = Found(), None, []
        for b in batches:  # in order: the words of a block are neighbours
            for *place, word, n in zip(*(b.column(x).to_pylist() for x in [*PLACE, "word", "n"]), strict=True):
                if place != at:
                    if items:
                        scan(*at[:3], items, found)
                    at, items = place, []
                    if len(found.of) > most:
                        yield found.batch()
                items.append((word, n))
        if items:
            scan(*at[:3], items, found)
        yield found.batch()

    ordered = placed.repartitionByRange(max(parts(placed.sparkSession), 1), *PLACE).sortWithinPartitions(*PLACE)
    partial = ordered.mapInArrow(run, "word string, times long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near"))).alias("best")
    return partial.groupBy("word").agg(F.sum("times").alias("n_near"), best).select("word", "n_near", (-F.col("best.k")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of ``forms`` (word, form): the last word that forms lead to."""
    spark = forms.sparkSession
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(spark, now)
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        now = nxt.drop("moved")


def spelling_variants(df: DataFrame, every: int = 97, letters: int = 5, least: int = 3, times: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialise(vocabulary(df, every, letters, least, id_col, text_col), "words")
    found = words.join(near_words(dictionaries(words, letters, block)), "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    rows = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    led = rows.join(roots(rows.where("form is not null")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


__all__ = ["dictionaries", "near_words", "query", "roots", "spelling_variants", "vocabulary"]
