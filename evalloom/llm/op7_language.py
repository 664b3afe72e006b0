"""Language ID: compression classification.

Per language a raw-content zstandard dictionary is built from a bounded sample of labelled texts, all of which
share its bytes evenly; a text longer than its share gives pieces from all over it.  A
text is lower-cased, everything that is not a letter becomes a space, and all of it is compressed
block by block with each dictionary; the language with the smallest total wins, ties going to the
language with more labelled documents.  The score is the margin, 1 - smallest / second smallest;
a narrow margin rejects.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; so is
every text when there is nothing to learn from.  With a single learned language the score is 1.
Rows stand alone; repeated rows get equal results, are learned from once, and extra columns are ignored or passed on
(``names`` keeps the results' names clear of them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.common import column, slices, table

BLOCK = 16384
PAD = b" " * 64  # so that a short block is always stored compressed and lengths differ by content alone
LEVEL = 6
#: Narrower margins reject.
MARGIN = 0.005
#: The bounds of the sample: documents a language, dictionary bytes a language and in all.
SAMPLE, DICTIONARY, ALL_DICTIONARIES = 256, 256 << 10, 64 << 20
LANGUAGES, COLLECTED = 1024, 64 << 20  # labels that are learned, bytes of the sample that reach the driver
PIECE = 256  # bytes of a piece of a text that is longer than its share

_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_KEEP).split())


def spread(raw: bytes, size: int) -> bytes:
    """At most ``size`` bytes of a text: all of it, or pieces at even distances from its begin to its end."""
    if len(raw) <= size:
        return raw
    n = -(-size // PIECE)
    width = size // n
    starts = [(len(raw) - width) * i // max(1, n - 1) for i in range(n)]
    return b"".join(raw[a : a + width] for a in starts)


def even(raws: list[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes at most to which every text gives as much as any other, or all it has."""
    room, share = size, 0
    for i, n in enumerate(sorted(len(r) + 1 for r in raws)):
        share = room // (len(raws) - i)
        if n > share:
            break
        room -= n
    else:
        share = size
    return b" ".join(spread(r, share - 1) for r in raws if share > 1)[:size] or b" "


@dataclass
class Model:
    """Languages by falling number of labelled documents, each with its dictionary."""

    languages: list[str]
    dictionaries: list[bytes]


class Classifier:
    def __init__(self, model: Model):
        import zstandard as z

        self.languages, self.compress = model.languages, []
        for content in model.dictionaries:
            params = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0, dict_size=len(content), source_size=4096, min_match=3)
            dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            self.compress.append(z.ZstdCompressor(dict_data=dictionary, compression_params=params).compress)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        raw = normal(text)
        pieces = [PAD + raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(compress(p)) for p in pieces) for compress in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.languages[0], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.languages[best], 1 - sizes[best] / second


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Learn from rows with a label; per language at most ``sample`` distinct texts, those with the smallest hash; copies only where these leave room.

    Counting is an aggregation with map-side combining; then a hash threshold per language lets only
    about twice the sample through, whatever the size of the table, and each text is thinned where it is read.
    At most ``languages`` labels are learned, the most frequent ones, and at most about ``COLLECTED`` bytes are collected.
    """
    spark = df.sparkSession
    rows = df.select(column(lang_col).alias("lang"), column(id_col).cast("string").alias("id"), column(text_col).alias("text")).where("lang is not null and text is not null")
    by_text, by_row = (F.pmod(F.xxhash64(*c), F.lit(1 << 30)) for c in (["text"], ["id", "text"]))
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(by_text).alias("texts")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = {r.lang: r.n for r in seen}
    if not counts:
        return Model([], [])
    size = min(DICTIONARY, ALL_DICTIONARIES // len(counts))
    most = max(PIECE, min(16 * size // sample, COLLECTED // (2 * len(counts) * sample)))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raws = [spread(normal(t or ""), most) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(raws, pa.binary())], ["lang", "h", "raw"])

    def sampled(h: Column, n: str) -> list:
        """About twice the sample's rows a language pass the threshold; the first of each row or text stay."""
        cut = spark.createDataFrame([(r.lang, int((1 << 30) * min(1.0, (2 * sample + 50) / max(r[n], 1)))) for r in seen], "lang string, cut long")
        near = rows.join(F.broadcast(cut), "lang").where(h < F.col("cut")).select("lang", h.alias("h"), "text").mapInArrow(thin, "lang string, h long, raw binary").distinct()
        return near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "raw"))).where(F.col("r") <= sample).drop("r").collect()

    by: dict[str, list[bytes]] = {}
    for r in sorted(sampled(by_text, "texts"), key=lambda r: r.h):
        by.setdefault(r.lang, []).append(bytes(r.raw))
    if any(len(by[r.lang]) < min(sample, r.n) for r in seen if r.lang in by):
        # What room there is goes to further copies.
        copies: dict[str, list[bytes]] = {}
        for r in sorted(sampled(by_row, "n"), key=lambda r: r.h):
            copies.setdefault(r.lang, []).append(bytes(r.raw))
        for lang, raws in copies.items():
            held = Counter(by.setdefault(lang, []))
            for raw in raws:
                held[raw] -= 1
                if held[raw] < 0 and len(by[lang]) < sample:
                    by[lang].append(raw)
    order = sorted(by, key=lambda lang: (-counts[lang], lang))
    return Model(order, [even(by[lang], size) for lang in order])


RESULT = ("lang_pred", "score", "rejected")


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, margin: float = MARGIN, names: tuple[str, ...] | list[str] = RESULT) -> DataFrame:
    """``keep`` (default: all columns but the text), then the prediction, its score and whether it is rejected, under ``names``."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*(column(c).alias(f"k{i}") for i, c in enumerate(keep)), column(text_col).alias("text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "lang_pred string, score double, rejected boolean"])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for b in slices(batches, 1024):
            got = [classify(t) for t in b.column(n).to_pylist()]
            langs, scores = [g[0] for g in got], [g[1] for g in got]
            bad = [lang == "und" or s < margin for lang, s in got]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())], [*(f"k{i}" for i in range(n)), *RESULT])

    return src.mapInArrow(run, schema).toDF(*keep, *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
