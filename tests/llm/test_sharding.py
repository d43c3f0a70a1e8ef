"""Shards against a plain Feistel walk in Python, on small tables."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from changefeed.llm import sharding
from tests.llm.test_llm import SCHEMA, documents


def plain_hash(x: int, key: int) -> int:
    z = ((x + key) * sharding.FIRST + key) % sharding.PRIME
    z = ((z ^ z >> 13) * sharding.SECOND) % sharding.PRIME
    return z ^ z >> 11


def plain(x: int, n: int, seed: int) -> int:
    a, b = sharding.bases(n)
    while True:
        left, right = divmod(x, b)
        for i, key in enumerate(sharding.keys_of(seed)):
            if i % 2 == 0:
                left = (left + plain_hash(right, key)) % a
            else:
                right = (right + plain_hash(left, key)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 50, 97, 1000])
def test_permutation_covers_all_slots_and_can_be_undone(spark, n):  # noqa: ANN001
    a, b = sharding.bases(n)
    assert a * b >= n > a * b - a
    placed = sharding.place(spark.range(n).withColumnRenamed("id", "number"), n, 3, seed=5).collect()
    assert [(r.slot * 3 + r.shard) for r in sorted(placed, key=lambda r: r.number)] == [plain(x, n, 5) for x in range(n)]
    assert sorted(r.slot * 3 + r.shard for r in placed) == list(range(n))
    there = spark.createDataFrame([(r.shard, r.slot) for r in placed], "shard int, slot long")
    back = {(r.shard, r.slot): r.number for r in sharding.number_at(there, n, 3, seed=5).collect()}
    assert back == {(r.shard, r.slot): r.number for r in placed}


def test_long_walks_go_on_past_one_expression(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(sharding, "STEPS", 0)
    n = 10_101  # a * b is 10,201, so a hundred results lie outside
    assert sharding.bases(n) == (101, 101)
    rows = sharding.place(spark.range(n).withColumnRenamed("id", "number"), n, 8, seed=9).collect()
    assert sorted(r.slot * 8 + r.shard for r in rows) == list(range(n))


def test_shards_of_odd_documents(spark):  # noqa: ANN001
    rows = [*documents(), *[(None, "copy", "en", "a", 1, None, None, None)] * 40]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in sharding.digests(docs).collect()]
    facts = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
    facts.sort(key=lambda f: (f[0] is None, f[0] or 0, f[2], f[1]))
    want = []
    for number, fact in enumerate(facts):
        y = plain(number, len(facts), sharding.SEED)
        want.append((*fact, "rows", y % 8, y // 8, None))
    assert Counter(got) == Counter(want)
    assert Counter(tuple(r) for r in sharding.digests(docs.repartition(2)).collect()) == Counter(want)
    sizes = Counter(r[4] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r[5] for r in got if r[4] == shard) == list(range(n))


def test_empty_table_and_main_path_without_python(spark):  # noqa: ANN001
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.digests(empty).count() == 0
    docs = spark.createDataFrame(documents(), SCHEMA)
    plan = sharding.digests(docs)._jdf.queryExecution().toString() + sharding._facts(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_written_shards_hold_whole_documents_with_clashing_names(spark, tmp_path):  # noqa: ANN001
    docs = spark.createDataFrame(documents(), SCHEMA).withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("number", F.lit(2))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(str(tuple(r.document)) for r in back.collect()) == Counter(str(tuple(r)) for r in docs.collect())
    for shard in range(4):
        slots = sorted(r.slot for r in back.where(F.col("shard") == shard).collect())
        assert slots == list(range(len(slots)))
