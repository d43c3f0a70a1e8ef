"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features are runs of 1 to ``n`` consecutive folded words, joined by one space; a feature's bucket is the CRC-32 of
its bytes modulo ``buckets``. Counts over all documents and over all target texts give each bucket a gain; a document's
weight is the floored mean gain of its features; a hash of its id gives Gumbel noise; the highest scores are drawn.

The checksums of all features of a piece of text are made at once. CRC-32 is linear in the bytes: byte b with d bytes
behind it in its feature always contributes ``POSITIONS[d][b]``, so a feature's checksum is the XOR of its bytes'
contributions (``bitwise_xor.reduceat`` over the spans) and of a constant for its length. Features longer than the
table are folded block by block: the checksum so far is put over the next block's first four bytes.

Passes: one counts buckets per task and adds them up (at most ``buckets`` rows a task), one reads the texts again with
the gains, ``buckets`` numbers, at hand. Only id, count and weight of a document travel; ranks come from
a distributed sort (``common.numbered``).

Null texts have no features; documents and targets without features have weight 0. A null id is hashed as ``null`` and
ranks last among ties. Repeated rows count and rank each for itself. An empty table gives no rows; an empty target
leaves the gains to the smoothing. A long text is read in pieces cut between words, so memory is bounded by its
bytes and its longest word. Other columns are not read; ``drawn`` returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.llm import spans
from changefeed.llm.common import materialise, numbered

NGRAMS = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# Distances from the end that the table holds; longer features are folded in blocks of so many bytes.
DISTANCES = 64
POLYNOMIAL = 0xEDB88320
ONES = 0xFFFFFFFF


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Contribution of byte b with d bytes behind it, at [d * 256 + b], and the constant of each length."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = np.where(register & 1, register >> 1 ^ np.uint32(POLYNOMIAL), register >> 1).astype(np.uint32)
    one_byte, rows, constants, state = register, [register], [0], ONES
    for _ in range(DISTANCES - 1):
        rows.append(one_byte[rows[-1] & 0xFF] ^ rows[-1] >> 8)
    for _ in range(DISTANCES):
        state = int(one_byte[state & 0xFF]) ^ state >> 8
        constants.append(state ^ ONES)
    return np.concatenate(rows), np.array(constants, np.uint32)


POSITIONS, LENGTHS = _tables()


def _folded(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of spans longer than the table, a block of all of them at a time."""
    length = ends - begins
    head = (length - 1) % DISTANCES + 1  # what is left over is the first block, all others are full
    register = _short(data, begins, begins + head) ^ np.uint32(ONES)
    at, live = begins + head, np.arange(len(begins))
    while len(live):
        block = data[at[live, None] + np.arange(DISTANCES)].astype(np.uint32)
        block[:, :4] ^= register[live, None] >> np.array([0, 8, 16, 24], np.uint32) & 0xFF
        distance = np.arange(DISTANCES - 1, -1, -1) * 256
        register[live] = np.bitwise_xor.reduce(POSITIONS[distance + block], axis=1)
        at[live] += DISTANCES
        live = live[at[live] < ends[live]]
    return register ^ np.uint32(ONES)


def _short(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = ends - begins
    close = np.cumsum(length)
    index = np.arange(close[-1]) - np.repeat(close - length, length)
    bytes_at = data[np.repeat(begins, length) + index]
    distance = np.repeat(length, length) - index - 1
    return np.bitwise_xor.reduceat(POSITIONS[distance * 256 + bytes_at], close - length) ^ LENGTHS[length]


def checksums(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span of ``data``; spans hold a byte at least and may overlap."""
    out = np.zeros(len(begins), np.uint32)
    long = ends - begins > DISTANCES
    for which, of in ((np.flatnonzero(~long), _short), (np.flatnonzero(long), _folded)):
        if len(which):
            out[which] = of(data, begins[which], ends[which])
    return out


def _joined(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words alone, a space behind each, and their spans there."""
    length = ends - begins
    close = np.cumsum(length + 1)
    first = close - length - 1
    out = np.full(int(close[-1]) if len(close) else 0, 0x20, np.uint8)
    index = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(first, length) + index] = data[np.repeat(begins, length) + index]
    return out, first, first + length


def features(texts: pa.Array, ngrams: int, buckets: int, piece: int = spans.PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, bucket and words of each feature of a column of texts, piece by piece."""
    data, bounds = spans.buffers(texts)
    carried, carried_row = np.zeros(0, np.uint8), -1
    for first, _, cut in spans.pieces(data, bounds, piece):
        folded = spans.FOLD[data[int(cut[0]) : int(cut[-1])]]
        begins, ends, row = spans.words(folded, cut - cut[0])
        row = row + first
        old = 0
        if ngrams > 1:
            folded, begins, ends = _joined(folded, begins, ends)
            if carried_row == first and len(carried):  # the last words of this row's piece before
                old = int((carried == 0x20).sum())
                folded = np.concatenate([carried, folded])
                begins, ends, _ = spans.words(folded, np.array([0, len(folded)]))
                row = np.concatenate([np.full(old, first), row])
            keep = row[-(ngrams - 1) :] == (row[-1] if len(row) else -1)
            tail = int(keep.sum())
            carried = folded[begins[-tail] :] if tail else np.zeros(0, np.uint8)
            carried_row = int(row[-1]) if len(row) else -1
        for n in range(1, ngrams + 1):
            k = len(row) - n + 1
            if k <= 0:
                break
            last = np.arange(k) + n - 1
            whole = np.flatnonzero((row[:k] == row[last]) & (last >= old))
            if len(whole):
                sums = checksums(folded, begins[whole], ends[whole + n - 1])
                yield row[whole], sums % np.uint32(buckets), np.full(len(whole), n == 1)


def bucket_counts(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of the frame's one column fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0), ngrams, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, by how much likelier the target's features fall into it than the documents'."""
    spark = docs.sparkSession
    counts = [materialise(bucket_counts(d, ngrams, buckets), "buckets") for d in (docs, target)]
    total = [c.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] for c in counts]
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = ((t + 1) * (F.lit(total[0]) + buckets)) / ((s + 1) * (F.lit(total[1]) + buckets))
    rows = (
        spark.range(buckets)
        .withColumnRenamed("id", "bucket")
        .join(counts[0].withColumnRenamed("n", "s"), "bucket", "left")
        .join(counts[1].withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    )
    return [r.gain for r in rows.orderBy("bucket").collect()]


def weighted(keyed_texts: DataFrame, gain: list[int], ngrams: int = NGRAMS) -> DataFrame:
    """n_features, n_words and weight of each row (text, then columns that are passed on)."""
    table, names = np.array(gain, np.int64), keyed_texts.columns[1:]
    passed = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed_texts.schema.fields[1:]]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            count, words, total = (np.zeros(n, np.int64) for _ in range(3))
            for row, bucket, single in features(batch.column(0), ngrams, len(table)):
                low = int(row[0])
                ones = np.bincount(row - low)
                count[low : low + len(ones)] += ones
                words[low : low + len(ones)] += ones if single[0] else 0
                cuts = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[cuts]] += np.add.reduceat(table[bucket], cuts)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            new = [pa.array(x) for x in (count, words, weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], [*names, "n_features", "n_words", "weight"])

    return keyed_texts.mapInArrow(weigh, ", ".join([*passed, "n_features long", "n_words long", "weight long"]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, seed: int, least: int, percent: int) -> DataFrame:
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least)
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = numbered(rows, order, "place")
    able = placed.where("able").count()
    drawn = F.col("able") & (F.col("place") < percent * able // 100)
    return placed.withColumn("rank", F.when(drawn, F.col("place") + 1))


def _text(docs: DataFrame) -> Column:
    return F.col("`text`").cast("string").alias("text")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank (null: not drawn) of each document (doc_id, text)."""
    gain = gains(docs.select(_text(docs)), target.select(_text(target)), ngrams, buckets)
    rows = weighted(docs.select(_text(docs), F.col("`doc_id`").cast("long").alias("doc_id")), gain, ngrams)
    return _ranked(rows, seed, least, percent).drop("able", "place")


def drawn(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The drawn documents themselves, whole, best first within each file; ids must be unique and not null."""
    ranks = resampled(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("__id"), F.col("rank").alias("__rank"))
    return docs.join(ranks, docs["doc_id"] == F.col("__id")).sortWithinPartitions("__rank").drop("__id", "__rank")


def oracle(buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT) -> str:
    """Single words in DuckDB; checksums of distinct words only."""
    from changefeed.llm.sharding import CRC_TABLE, crc_sql

    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    # Only A-Z: translate maps character by character.
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with {CRC_TABLE},
d as (select row_number() over () as r, doc_id, regexp_extract_all({folded}, '{pattern}') as ws from documents),
b as (select regexp_extract_all({folded}, '{pattern}') as ws from benchmark),
dw as (select r, unnest(ws) as w from d), bw as (select unnest(ws) as w from b),
hashed as (select w, ({crc_sql("w")} % {buckets})::bigint as bucket from (select w from dw union select w from bw), table_of),
s as (select bucket, count(*) as s from dw join hashed using (w) group by bucket),
t as (select bucket, count(*) as t from bw join hashed using (w) group by bucket),
gains as (select x as bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + {buckets}))
  / ((coalesce(s, 0) + 1)::double * ((select count(*) from bw) + {buckets}))))::bigint as gain
  from (select unnest(range({buckets})) as x) left join s on s.bucket = x left join t on t.bucket = x),
weights as (select r, floor(sum(gain)::double / count(*))::bigint as weight from dw join hashed using (w) join gains using (bucket) group by r),
scored as (select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
  (('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score from d left join weights using (r)),
ranked as (select *, row_number() over (partition by n_features >= {least} order by score desc, doc_id nulls last) as place from scored)
select doc_id, n_features, weight, score, case when n_features >= {least} and place <= {percent} * (select count(*) from scored where n_features >= {least}) // 100
  then place end as rank from ranked"""
