"""Ranked search against every document scored in Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from changefeed.llm import search
from tests.llm.test_llm import SCHEMA, documents

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> Counter:
    return Counter(m.lower() for m in TERM.findall((text or "").encode()))


def plain(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    counted = [(d[0], terms(d[1])) for d in docs]
    df = Counter(t for _, c in counted for t in c)
    n, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in counted:
            m = 100 - 25 + (25 * c.total() * n) // max(total, 1)
            score = 0
            for t, repeats in terms(text).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += repeats * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, missing, doc_id) in enumerate(sorted(scores)[:k]):
            out.append((item, rank + 1, None if missing else doc_id, -score))
    return out


def queries(rows: list[tuple]) -> list[tuple]:
    texts = [r[1] for r in rows]
    return [(i, " ".join((texts[3 * i] or "").split()[:12])) for i in range(12)] + [(20, texts[4]), (20, texts[4]), (21, None), (22, "?"), (None, texts[9]), (23, "nowhere"), (24, "one ONE One two")]


@pytest.fixture
def small_blocks(monkeypatch):  # noqa: ANN001, ANN201
    for name, value in (("BLOCK_DOCUMENTS", 16), ("QUERIES_A_BLOCK", 4), ("QUERY_BYTES", 2000)):
        monkeypatch.setattr(search, name, value)


def test_search_equals_plain_version(spark):  # noqa: ANN001
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "term": F.lit(1), "tf": F.lit(2)}).repartition(3)
    items = spark.createDataFrame(queries(rows), "item_id long, text string").withColumn("number", F.lit(0))
    got = search.search(docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, queries(rows)))


def test_small_blocks_of_documents_and_queries(spark, small_blocks):  # noqa: ANN001
    rows = [*documents(), *[(1000 + i, "one one two", "en", "a", 1, None, None, None) for i in range(60)]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    items = spark.createDataFrame(queries(rows), "item_id long, text string")
    assert len(list(search.blocks(search.query_terms(items)))) > 3
    got = search.search(docs, items, 5)
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, queries(rows), 5))


def test_empty_tables(spark):  # noqa: ANN001
    empty, none = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert search.search(empty, some).count() == search.search(empty, none).count() == search.search(spark.createDataFrame(documents(), SCHEMA), none).count() == 0


def test_long_texts_are_cut_between_terms():
    text = " ".join(random.Random(1).choices(["ab", "Cd", "é1", "x" * 5000], k=6000)).encode()
    assert len(text) > 2 * search.spans.PIECE
    pieces = list(search.terms(text))
    assert len(pieces) > 2 and [t for p in pieces for t in p] == [t.lower() for t in TERM.findall(text)]


def test_reading_stops_before_the_lists_end_and_ties_are_resolved():
    rnd = np.random.default_rng(4)
    for trial in range(200):
        n, k = int(rnd.integers(1, 60)), int(rnd.integers(1, 8))
        lists, scores = [], np.zeros(n, np.int64)
        for _ in range(int(rnd.integers(1, 6))):
            docs = rnd.permutation(n)[: int(rnd.integers(0, n + 1))]
            impacts = -np.sort(-rnd.integers(0, 6, len(docs)))
            lists.append((docs, impacts))
            scores[docs] += impacts
        ids = rnd.permutation(n)
        want = [d for d in np.lexsort((ids, -scores)) if scores[d] > 0][:k]
        places, found, _ = search.nra(lists, ids, k)
        assert places.tolist() == want and found.tolist() == scores[want].tolist(), trial
    impacts = np.arange(10_000, 0, -1) ** 2
    places, _, read = search.nra([(np.arange(10_000), impacts)], np.arange(10_000), 3)
    assert places.tolist() == [0, 1, 2] and read < 10_000
