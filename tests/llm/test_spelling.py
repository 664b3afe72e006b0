"""Operator 12 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom.llm import op12_spelling as op
from tests.llm.test_ops import documents, empty, odd

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(u, v):
    """Exactly one inserted, deleted or replaced letter."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(rows, every=97, letters=5, least=3):
    found = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return judged({w: n for w, n in found.items() if len(w) >= letters and n >= least})


def judged(words):
    # Only words that share a word with one letter masked or missing can be near; every such pair is then tested.
    at = {}
    for w in words:
        for i in range(len(w)):
            at.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        at.setdefault(w, set()).add(w)
    nears = {w: {v for k in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] for v in at.get(k, ()) if near(w, v)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(nears[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(nears[w]), words.get(form[w])))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_tables(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert result(op.query(spark, small)) == plain([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("block", [3, 40])
def test_blocks_are_subdivided(spark, block):
    """Words of few letters over a small alphabet: every block is hot, and there are long chains of forms."""
    rng = random.Random(block)
    words = Counter()
    for _ in range(1500):
        words["".join(rng.choices("abé", k=rng.randint(5, 9)))] += 1
    data = {w: 3 + n**3 + rng.randint(0, 4) ** 5 for w, n in words.items()}
    df = spark.createDataFrame(list(data.items()), "word string, n long")
    placed = op.dictionaries(df, 5, block)
    assert placed.groupBy(*op.PLACE).count().where((F.col("count") > block) & F.expr("c - a - b > 1")).count() == 0
    got = {r.word: (r.n_near, r.near) for r in op.near_words(placed, most=100).collect()}
    want = {}
    for w in data:
        nears = [v for v in data if near(w, v)]
        if nears:
            want[w] = (len(nears), min(nears, key=lambda v: (-data[v], v)))
    assert got == want


def test_pairs_of_every_kind():
    """Insertions, deletions and replacements at every place, runs of one letter included, are found once."""
    rng = random.Random(3)
    for _ in range(60):
        words = {"".join(rng.choices("ab", k=rng.randint(5, 7))): rng.randint(1, 9) for _ in range(40)} | {"a" * k: k for k in range(5, 9)}
        for c in range(5, 9):
            found = op.Found()
            items = [x for x in words.items() if len(x[0]) in (c, c + 1)]
            op.scan(c, 0, 0, items, found)
            want = {w: [v for v, _ in items if near(w, v) and min(len(w), len(v)) == c] for w, _ in items}
            assert {w: x[0] for w, x in found.of.items()} == {w: len(v) for w, v in want.items() if v}


def test_forms_and_roots(spark):
    text = "colour " * 40 + "color " * 100 + "coler " * 10 + "colers " * 3 + "Colour, COLOUR! naïve naïve naïve naive " + "naive " * 9 + "abcd " * 50 + "zebra " * 2
    got = {r.word: r for r in op.spelling_variants(documents(spark, [(1, text)]), every=10**12).collect()}
    assert "zebra" not in got and "abcd" not in got
    assert (got["colour"].n, got["colour"].form, got["colour"].root) == (42, "color", "color")
    assert (got["coler"].form, got["coler"].n_near, got["colers"].form, got["colers"].root) == ("color", 2, "coler", "color")
    assert (got["naïve"].form, got["naive"].form, got["naive"].root, got["color"].form_n) == ("naive", None, "naive", None)


def test_deleted_letters(spark):
    data = [(i, "wording spelling") for i in range(300)]
    assert result(op.spelling_variants(documents(spark, data))) == plain(data)
    assert result(op.spelling_variants(documents(spark, data), every=2)) == plain(data, every=2)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert result(op.spelling_variants(odd(spark), least=1, letters=3)) == plain(rows, least=1, letters=3)
    assert op.spelling_variants(empty(spark)).collect() == []
    long = "q" * 5000
    data = [(1, f"{long} {long}x {long} {long}x {long} {long} {long}x " + f"{long} " * 3)]
    assert result(op.spelling_variants(documents(spark, data))) == plain(data)
