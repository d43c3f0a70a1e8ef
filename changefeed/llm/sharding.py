"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered by id (``common.numbered``). A number x below n is written as two digits, left below a
and right below b with a * b >= n, a and b near the root of n. Each round adds a keyed hash of one
digit to the other, modulo its base, so the rounds together permute the a * b pairs whatever the hash
does. A result of n or more is permuted again until it falls below n (cycle walking); as fewer than a
results lie there, that is rare. Row x then belongs to shard y mod s, slot y div s of its permuted number y.

So shards differ by one row at most, whatever the sizes of texts or the copies among them, slots have no
gaps, and both directions can be computed from n, s and the seed alone: ``place`` gives a row's shard and slot,
``number_at`` the row that stands in a slot.

Nulls: a null text has size 1 and the checksum of no bytes; rows without id come last in the numbering.
Rows equal in id, checksum and size are interchangeable, so reruns give the same rows, repeated ones
included. Copies of a text are rows like any other: the law is on counts. An empty table gives no rows.
Texts are measured where they are read and only their sizes travel, so their length does not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.llm.common import materialise, numbered, partitions

SHARDS = 8
SEED = 20_240
ROUNDS = 6
# Steps of cycle walking made in one expression; whatever is still outside then walks on in ``walked``.
STEPS = 8
# Fixed values of the hash: multipliers and the prime 2^31 - 1, so that no product leaves 64 bits.
PRIME, FIRST, SECOND = 2_147_483_647, 48_271, 69_621


def keys_of(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One number below 2^31 for each round."""
    return [int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) >> 1 for i in range(rounds)]


def bases(n: int) -> tuple[int, int]:
    """The bases of the two digits: a * b >= n > a * b - a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def hashed(x: Column, key: Column) -> Column:
    """A keyed hash of a number below 2^31, itself below 2^31."""
    z = ((x + key) * FIRST + key) % PRIME
    z = (z.bitwiseXOR(F.shiftright(z, 13)) * SECOND) % PRIME
    return z.bitwiseXOR(F.shiftright(z, 11))


def _rounds(seed: int, backwards: bool) -> Column:
    keys = [F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, k in enumerate(keys_of(seed))]
    return F.array(*(keys[::-1] if backwards else keys))


def permuted(x: Column, n: int, seed: int, backwards: bool = False) -> Column:
    """One pass of all rounds over a number below a * b, or of the rounds undone in reverse order."""
    a, b = (F.lit(v).cast("long") for v in bases(n))
    sign = -1 if backwards else 1

    def one(pair: Column, of: Column) -> Column:
        left = F.pmod(pair["l"] + sign * hashed(pair["r"], of["key"]), a)
        right = F.pmod(pair["r"] + sign * hashed(pair["l"], of["key"]), b)
        return F.struct(F.when(of["left"], left).otherwise(pair["l"]).alias("l"), F.when(of["left"], pair["r"]).otherwise(right).alias("r"))

    right = F.pmod(x, b)
    start = F.struct(((x - right) / b).cast("long").alias("l"), right.alias("r"))
    return F.aggregate(_rounds(seed, backwards), start, one, lambda pair: pair["l"] * b + pair["r"])


def walk(x: Column, n: int, seed: int, backwards: bool = False) -> Column:
    """A permuted number, walked on for up to ``STEPS`` steps while it is n or more."""
    first = permuted(x, n, seed, backwards)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), first, lambda y, _: F.when(y < n, y).otherwise(permuted(y, n, seed, backwards))
    )


def walked(rows: DataFrame, x: str, n: int, seed: int, to: str, backwards: bool = False) -> DataFrame:
    """``rows`` with the permutation of column ``x`` in column ``to``, every value below n."""
    out = materialise(rows.withColumn(to, walk(F.col(x), n, seed, backwards)), "walked")
    while out.where(F.col(to) >= n).take(1):
        further = F.when(F.col(to) < n, F.col(to)).otherwise(walk(F.col(to), n, seed, backwards))
        out = materialise(out.withColumn(to, further), "walked")
    return out


def place(rows: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED, number: str = "number") -> DataFrame:
    """``rows`` with the shard and slot of their row number, of n rows in all."""
    y = walked(rows, number, n, seed, "__y")
    return y.withColumn("shard", (F.col("__y") % shards).cast("int")).withColumn("slot", F.expr(f"__y div {shards}")).drop("__y")


def number_at(rows: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` (shard, slot) with the number of the row that stands there."""
    y = rows.withColumn("__y", F.col("slot").cast("long") * shards + F.col("shard"))
    return walked(y, "__y", n, seed, "number", backwards=True).drop("__y")


def _facts(docs: DataFrame, more: Callable[[], list[Column]] = list) -> DataFrame:
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    facts = (F.col("`doc_id`").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return docs.select(*facts, *more())


def assigned(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, number, shard, slot of each document (doc_id, text; others are not read)."""
    rows = numbered(_facts(docs), _order())
    return place(rows, rows.count(), shards, seed)


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Whole documents in their places: shard, slot, and all their columns in ``document``, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    rows = numbered(_facts(docs, lambda: [whole]), [*_order(), F.xxhash64("document")])
    return place(rows, rows.count(), shards, seed).select("shard", "slot", "document")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write ``sharded`` documents as Parquet, a folder for each shard, each file in the order of slots."""
    rows = sharded(docs, shards, seed)
    dealt = rows.repartitionByRange(max(shards, partitions(docs)), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The places of all documents by the law of equal counts; nothing moves by key, so no grown shard."""
    return assigned(docs, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# --- The same in DuckDB ------------------------------------------------------
# The checksum of a blob, byte by byte through a table made from the polynomial.
CRC_TABLE = """table_of as (select list(c order by i) as crc_table from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k:
  case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i)))"""


def crc_sql(text: str) -> str:
    """DuckDB's unsigned CRC-32 of the UTF-8 bytes of a text; needs ``crc_table`` in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, o: xor(c >> 8, crc_table[(xor(c, o) & 255) + 1])), 4294967295)"


def oracle(shards: int = SHARDS, seed: int = SEED) -> str:
    """The assignment in DuckDB: the whole permutation as a table, walked by a recursive query."""
    steps, last = [], "digits"
    for i, k in enumerate(keys_of(seed)):
        of, into, base = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        mixed = f"((({of} + {k}) * {FIRST} + {k}) % {PRIME})"
        steps.append(f"u{i} as (select *, xor({mixed}, {mixed} >> 13) * {SECOND} % {PRIME} as z from {last})")
        steps.append(f"v{i} as (select x, n, a, b, {of}, ({into} + xor(z, z >> 11)) % {base} as {into} from u{i})")
        last = f"v{i}"
    return f"""with recursive {CRC_TABLE},
facts as (select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, {crc_sql("coalesce(text, '')")} as text_crc32 from documents, table_of),
numbers as (select *, row_number() over (order by doc_id nulls last, text_crc32, size) - 1 as number from facts),
n_rows as (select count(*) as n, floor(sqrt(greatest(count(*) - 1, 0)))::bigint + 1 as a from documents),
sizes as (select n, a, greatest(1, (n + a - 1) // a) as b from n_rows),
digits as (select x, n, a, b, x // b as l, x % b as r from (select *, unnest(range(a * b)) as x from sizes)),
{", ".join(steps)},
once as (select x, n, l * b + r as y from {last}),
walk as (select x, n, y from once where x < n union all select w.x, w.n, o.y from walk w join once o on o.x = w.y where w.y >= w.n)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (y % {shards})::integer as shard, (y // {shards})::bigint as slot,
  null::integer as grown_shard from numbers join walk on x = number where y < n"""
