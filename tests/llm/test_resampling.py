"""Importance resampling against a plain version with zlib and hashlib."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changefeed.llm import resampling, spans
from tests.llm.test_llm import SCHEMA, documents

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text: str | None, ngrams: int) -> list[bytes]:
    words = WORD.findall((text or "").encode().lower())
    return [b" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def plain(docs: list[tuple], target: list[tuple], ngrams: int, buckets: int) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f) % buckets
    found = [[bucket(f) for f in plain_features(d[1], ngrams)] for d in docs]
    s, t = Counter(b for f in found for b in f), Counter(bucket(f) for d in target for f in plain_features(d[1], ngrams))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for d, f in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        rows.append([d[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_features(d[1], 1))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("ngrams, buckets", [(1, 10_000), (1, 50), (2, 97), (3, 1000)])
def test_resampling_equals_plain_version(spark, ngrams, buckets):  # noqa: ANN001
    rows, target = documents(), [(1, "one two abc"), (2, None), (None, ""), (3, documents()[0][1]), (3, "A-Z Éa 12")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "score": F.lit(0), "able": F.lit(1)}).repartition(3)
    got = resampling.resampled(docs, spark.createDataFrame(target, "item_id long, text string"), ngrams, buckets)
    got = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert Counter(got) == Counter(plain(rows, target, ngrams, buckets))


def test_checksums_of_spans_of_every_length(spark):  # noqa: ANN001
    data = np.frombuffer(random.Random(3).randbytes(70_000), np.uint8)
    lengths = [*range(1, 300), 1000, 4096, 65_000]
    begins = np.array([(7 * i) % 900 for i in range(len(lengths))])
    ends = begins + lengths
    got = resampling.checksums(data, begins, ends)
    assert got.tolist() == [zlib.crc32(data[b:e].tobytes()) for b, e in zip(begins, ends)]


@pytest.mark.parametrize("piece", [1, 7, 40, 1000])
@pytest.mark.parametrize("ngrams", [1, 2, 4])
def test_pieces_do_not_cut_words_or_features(spark, ngrams, piece):  # noqa: ANN001
    texts = [r[1] for r in documents(n=12)] + ["x" * 200 + " y " + "z" * 100, None, "--- ..", "é" * 90, "a b c d"]
    found = [Counter() for _ in texts]
    for row, bucket, _ in resampling.features(pa.array(texts), ngrams, 1 << 31, piece):
        for r, b in zip(row, bucket):
            found[r][int(b)] += 1
    assert found == [Counter(zlib.crc32(f) % (1 << 31) for f in plain_features(t, ngrams)) for t in texts]


def test_sliced_columns_and_rows_that_touch(spark):  # noqa: ANN001
    texts = pa.array(["zz", "ab", "cd", "", None, "ef gh", "ij"]).slice(1)
    data, bounds = spans.buffers(texts)
    begins, ends, row = spans.words(data, bounds)
    assert [(data[b:e].tobytes(), int(r)) for b, e, r in zip(begins, ends, row)] == [(b"ab", 0), (b"cd", 1), (b"ef", 4), (b"gh", 4), (b"ij", 5)]


def test_empty_tables_and_drawn_documents(spark):  # noqa: ANN001
    empty, none = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(empty, none).count() == 0
    docs = spark.createDataFrame([(i, " ".join(["word"] * (i % 40)), "en", "a", i, None, None, None) for i in range(200)], SCHEMA)
    ranks = resampling.resampled(docs, none).where("rank is not null").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 11)) and all(r.doc_id % 40 >= 20 for r in ranks)
    drawn = resampling.drawn(docs, none)
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in ranks)
