"""One bad row, many copies, very short texts: time, memory and padding stay in proportion."""

import random
import subprocess
import sys
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from evalloom.llm import op2_media, op4_packing, op7_language, op8_decontam, op9_urls
from tests.llm.test_ops import documents

GIF = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


@pytest.mark.parametrize("unit", [b"GIF89aAAAAAAA!", b"GIF89aAAAAAAA,AAAAAAAAAAA", b"GIF89a\x01\x00\x01\x00\x00\x00\x00!\xf9\x00", b"GIF89aAAAAAAA!\x01\x01"])
def test_gif_headers_without_an_end(unit):
    payload = unit * (1_000_000 // len(unit))
    begin = time.process_time()
    assert op2_media.Sniffer().spans(payload) == []
    assert time.process_time() - begin < 8


def test_gifs_are_found_among_false_headers():
    rng = random.Random(1)
    for _ in range(200):
        pieces = [rng.choice([GIF, b"GIF89aAAAAAAA!", b"x", b"GIF89a\x00\x00\x00\x00\x00\x00\x00!\xf9\x01a\x00", GIF[:-1] + b"!\xfe\x02ab\x00;"]) for _ in range(rng.randint(1, 12))]
        payload = b"".join(pieces)

        def alone(at):
            return op2_media.Gifs(memoryview(payload)).end(at)

        want, end = [], 0
        for at in range(len(payload)):
            if at >= end and payload.startswith(b"GIF89a", at) and (stop := alone(at)):
                want.append(("image/gif", at, stop))
                end = stop
        assert op2_media.Sniffer().spans(payload) == want


def test_media_beside_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(bytearray(GIF), "image/png", 7, "y")], "media binary, declared string, _media int, k0 string")
    row = op2_media.sniff(df, keep=("_media", "k0")).first()
    assert (row["_media"], row.k0, row.media_type, row.corrected) == (7, "y", "image/gif", True)


def test_hosts_of_many_dots():
    judge = op9_urls.UrlJudge([], [], 2, op9_urls.RULES)
    begin = time.process_time()
    assert judge.rule("." * 300_000 + "example.com", "/en/7") == ("example.com/en/7", "allow")
    assert judge.rule("a." * 300_000 + "net.", "/de/") is None
    assert time.process_time() - begin < 1
    assert judge.rule("example.com", "/en/1") == ("com/en/", "block") and judge.rule("", "/en/") is None


def naive_align(item, doc):
    m, n = len(item), len(doc)
    s = np.zeros((m + 1, n + 1), int)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            s[i, j] = max(0, s[i - 1, j - 1] + (1 if item[i - 1] == doc[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
    return s


def test_alignment_with_two_rows():
    rng = np.random.default_rng(2)
    for _ in range(150):
        item, doc = (rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64) for _ in range(2))
        score, equal, start, end = op8_decontam.align(item, doc)
        table = naive_align(item, doc)
        assert score == table.max() and 0 <= start <= end <= len(doc) and equal >= score
        if score:
            assert table[:, end].max() == score and naive_align(item, doc[start:end]).max() == score


def test_equal_words_take_bounded_memory(spark):
    """An item of 2,000 equal words against a text of 20,000."""
    items = op8_decontam.Items([(1, "na " * 2000)], 5)
    keys, starts, of, at_word = items.seeds()
    word = op8_decontam.shingles.words([b"na " * 20_000])[0]
    where, which = op8_decontam.Finder(keys, items.sizes)(word)
    tracemalloc.start()
    pairs = list(op8_decontam._pairs(np.zeros(len(where), np.int64), where, which, starts, of, at_word))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i) for d, i, _ in pairs] == [(0, 0)] and len(pairs[0][2]) == 19_996 + 1_996 - 1
    assert peak < 200 << 20


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pieces_of_hits_change_nothing(piece):
    rng = np.random.default_rng(5)
    owner, place, which = np.sort(rng.integers(0, 5, 60)), rng.integers(0, 30, 60), rng.integers(0, 4, 60)
    starts, of, at_word = np.array([0, 2, 3, 7, 9]), rng.integers(0, 3, 9), rng.integers(0, 20, 9)
    want = {}
    for o, p, w in zip(owner, place, which, strict=True):
        for k in range(starts[w], starts[w + 1]):
            want.setdefault((o, of[k]), set()).add(p - at_word[k])
    got = list(op8_decontam._pairs(owner, place, which, starts, of, at_word, piece))
    assert len({x[:2] for x in got}) == len(got) and {x[:2]: x[2] for x in got} == {k: sorted(v) for k, v in want.items()}


def test_short_documents_fill_sequences(spark):
    rng = random.Random(3)
    data = [(k, " ".join(rng.choices(["sea", "land", "wind", "tree"], k=rng.randint(0, 11)))) for k in range(12_000)]
    got = op4_packing.pack(documents(spark, data).coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), 1).toPandas()
    sequences = got.sequence_id.nunique()
    assert 1 - got.length.sum() / (2048 * sequences) < 0.02


def test_copies_of_a_text_displace_no_other(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["der", "die", "das", "und", "ist", "haus", "baum", "wasser"], k=30)) for _ in range(40)]
    rows = [(k, "ein und derselbe satz, immer wieder", "de") for k in range(400)] + [(1000 + k, t, "de") for k, t in enumerate(texts)] + [(2000, "one in english", "en")]
    model = op7_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=64)
    held = dict(zip(model.languages, model.dictionaries, strict=True))["de"]
    assert held.count(b"derselbe") == 64 - 40 and all(t.split(" ", 1)[1][:40].encode() in held for t in texts)


def test_labels_are_bounded(spark):
    rows = [(k, f"text of label {k % 5}", f"l{k % 5}") for k in range(25)] + [(99, "rare", "rare")]
    model = op7_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=5)
    assert sorted(model.languages) == [f"l{k}" for k in range(5)]


def test_missing_libraries_leave_the_other_queries():
    """Without one of the libraries of the training-data operators the rest of the engine is there."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'accuracy_global' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q), len(s))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])
    assert done.returncode == 0, done.stderr


def test_hot_identifiers_are_written_by_many_tasks(spark):
    """Half of the rows have no identifier, a third have one and the same, and half of these are one text."""
    from evalloom.llm import op3_sstable
    from evalloom.llm.common import fresh

    rng = random.Random(6)
    texts = ["the same text, again and again", *(" ".join(rng.choices(["sea", "land", "wind", "tree"], k=9)) for _ in range(400))]
    data = [(None if k % 2 else 7 if k % 6 else k, texts[0] if k % 4 < 2 else rng.choice(texts)) for k in range(3000)]
    df = documents(spark, data).repartition(8)
    manifest = op3_sstable.write_shards(df, fresh(spark, "hot"), public_tokenizers.path("word_bpe_49k.json"), 2, shards=8)
    assert max(r.rows for r in manifest.collect()) < 900
    rows = op3_sstable.read_shards(manifest).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    named = [i for i in ids if i is not None]
    assert named == sorted(named) and ids == named + [None] * data.count((None, None)) + ids[len(named) :] and len(ids) == 3000
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert sum(i == 7 for i in named) == sum(i == 7 for i, _ in data)
    assert len(op3_sstable.lookup(manifest, spark.createDataFrame([(7,)], "doc_id long")).collect()) == sum(i == 7 for i, _ in data)
