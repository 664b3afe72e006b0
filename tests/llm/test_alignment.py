"""Operator 11 against both libraries as they are."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from evalloom.llm import op11_alignment as op
from tests.llm.test_ops import documents, empty, odd

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """The definition, over (doc_id, text): every text is encoded whole."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    symbols = op.byte_symbols()
    known, links = [], collections.Counter()
    for ident, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        ends = []
        for pieces in ([bytes(symbols[c] for c in a.id_to_token(i)) for i in x], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]):
            if b"".join(pieces) != (" " + text).encode() if text else False:
                x = y = []
            ends.append(np.cumsum([len(p) for p in pieces]).tolist())
        if not x:
            known.append((ident, [], [], [], ""))
            continue
        groups, i0, j0 = [], 0, 0
        at_b = {e: j for j, e in enumerate(ends[1])}
        mine = []
        for i, e in enumerate(ends[0]):
            if e in at_b:
                j = at_b[e]
                groups.append(",".join(map(str, x[i0 : i + 1])) + "|" + ",".join(map(str, y[j0 : j + 1])))
                mine.append((x[i], y[j]))
                i0, j0 = i + 1, j + 1
        links.update(mine)
        known.append((ident, x, y, mine, ";".join(groups)))
    best = collections.Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return [(i, len(x), len(y), len(m), len(m), sum(links[k] == best[k[1]] for k in m), sum(links[k] for k in m), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, m, g in known]


def result(df, **kw):
    return sorted((tuple(r[c] for c in COLUMNS) for r in op.align_tokenizers(df, A, B, **kw).collect()), key=repr)


def test_tables(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in op.query(spark, small).collect()), key=repr) == sorted(plain([(r.doc_id, r.text) for r in df.collect()]), key=repr)


def test_odd_texts(spark):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", "\x1c", "\x85", " ", " ", "a", "the", "The", "'s", "don't", "123", "é", "é", "▁", "中文", "😀", "<|endoftext|>", "<s>", "<0x41>", "\x00", "ﬁ", "﻿", ".", "!!", "\r\n", "   "]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(400)] + ["", None, " ", "word " * 20_000, "x" * 30_000, " a ▁ b"]
    data = [(None if k % 50 == 0 else k // 2, t) for k, t in enumerate(texts)]
    assert result(documents(spark, data).repartition(5)) == sorted(plain(data), key=repr)


def test_repeats_nulls_and_columns(spark):
    got = result(odd(spark))
    assert got == sorted(plain([(r.doc_id, r.text) for r in odd(spark).collect()]), key=repr)
    assert op.align_tokenizers(empty(spark), A, B).collect() == []
    nothing = documents(spark, [(1, None), (2, ""), (3, "▁")])
    assert result(nothing) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


@pytest.mark.parametrize("shards", [1, 7])
def test_shards_and_flushes(spark, small, shards):
    """Counts do not depend on how many files hold them, nor on what a partition sends at once."""
    df = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    rows = op.aligned(df, A, B)
    counts = {r.key: r.n for r in op.partial_counts(rows).groupBy("key").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    manifest = op.count_shards(op.partial_counts(rows.repartition(3), most=50), op.fresh(spark, "t"), shards)
    held = {}
    for f in manifest.collect():
        keys, numbers = op.mapped(f.path, f.size)
        assert (np.diff(keys) > 0).all() and f.first_key == keys[0] and f.last_key == keys[-1]
        assert not held.keys() & set(keys.tolist())
        held |= dict(zip(keys.tolist(), numbers.tolist(), strict=True))
    assert held == counts


def test_vocabulary_with_crossing_pieces_is_not_cut():
    both = op.Pair(A, B)
    assert both.cuts
    texts = ["one two  three ", "a\n b", "\n", None]
    cut = [x[:3] for x in both.align(texts)]
    both.cuts, both.memo = False, {}
    assert cut == [x[:3] for x in both.align(texts)]
