"""Column expressions used throughout: keys, hashes, names, fallbacks.

Every function returns a ``Column`` built from Spark built-ins, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.spec import OP_DELETE, OP_INSERT, OP_UPDATE

# --- Fixed values -----------------------------------------------------------
ENVELOPE_OPS = {OP_DELETE: "d", OP_INSERT: "c", OP_UPDATE: "u"}
UNLISTED_OP = "c"
OPERATION_NAMES = {"d": "DELETE", "c": "INSERT", "u": "UPDATE"}
SNAPSHOT_OPERATION = {"r": "READ"}
UNKNOWN_OPERATION = "UNKNOWN"
IDENTIFIER_LETTERS = {"å": "a", "Å": "A", "ø": "o", "Ø": "O"}
IDENTIFIER_LIGATURES = {"æ": "ae", "Æ": "AE"}
EMPTY_IDENTIFIER = "unnamed"
# --- End of fixed values ----------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: Mapping[object, object], key: Column | str) -> Column:
    """Look ``key`` up in a small fixed mapping; null when absent."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), _col(key))


def decode_op(col: Column | str, strict: bool = False) -> Column:
    """Operation code -> envelope letter. An unlisted code is an insert, or null if strict."""
    code = _col(col)
    fallback = F.lit(None).cast("string") if strict else F.lit(UNLISTED_OP)
    chain = None
    for value, letter in ENVELOPE_OPS.items():
        chain = (F.when if chain is None else chain.when)(code == value, letter)
    return chain.otherwise(fallback)


def op_name(col: Column | str, snapshots: bool = False) -> Column:
    """Envelope letter -> operation name; optionally ``r`` as READ."""
    names = {**OPERATION_NAMES, **(SNAPSHOT_OPERATION if snapshots else {})}
    return F.coalesce(lookup(names, col), F.lit(UNKNOWN_OPERATION))


def message_key(cols: Sequence[Column | str]) -> Column:
    """Key parts as text joined with ``|``; a null part becomes an empty part."""
    return F.concat_ws("|", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols])


def topic_name(prefix: Column | str, schema: Column, table: Column, fmt: str | None = None) -> Column:
    """``prefix.schema.table``, or ``fmt`` with ``{prefix}``, ``{schema}`` and ``{table}`` filled in."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    if fmt is None:
        return F.concat_ws(".", prefix, schema, table)
    text = F.lit(fmt)
    for name, value in (("prefix", prefix), ("schema", schema), ("table", table)):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def normalize_identifier(col: Column | str) -> Column:
    """Norwegian letters to ASCII, keeping case."""
    out = F.translate(_col(col), "".join(IDENTIFIER_LETTERS), "".join(IDENTIFIER_LETTERS.values()))
    for letter, pair in IDENTIFIER_LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def safe_identifier(col: Column | str) -> Column:
    """Runs of other characters become one ``_``; outer ``_`` go; empty becomes a fixed name."""
    text = F.regexp_replace(_col(col), r"[^A-Za-z0-9_]+", "_")
    text = F.regexp_replace(text, r"^_+|_+$", "")
    return F.when(text == "", EMPTY_IDENTIFIER).otherwise(text)


def row_hash(cols: Sequence[str]) -> Column:
    """sha256 hex of the named columns as JSON, in name order, nulls included."""
    ordered = F.struct(*[F.col(c) for c in sorted(cols)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def idempotency_key(cols: Sequence[Column | str], length: int = 32) -> Column:
    """First ``length`` hex characters of the sha256 of the concatenated parts."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, length)


def value_map(col: Column | str, mapping: Mapping[object, object], default: object) -> Column:
    """Map a value, with a default for anything unlisted (null included)."""
    return F.coalesce(lookup(mapping, col), F.lit(default))


def json_field(col: Column | str, path: str, default: object) -> Column:
    """A field of JSON text; bad JSON, a missing field and null all give the default."""
    return F.coalesce(F.get_json_object(_col(col), path), F.lit(default))


def first_present(*cols: Column | str, lower: bool = False, default: object = None) -> Column:
    """First non-null of several columns, trimmed, optionally lower-cased."""
    parts = [_col(c) for c in cols]
    value = F.trim(F.coalesce(*parts, F.lit(default)).cast("string"))
    return F.lower(value) if lower else value


def missing_fields(required: Sequence[str]) -> Column:
    """Array of the required column names that are null in this row."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))


def any_of(conditions: Sequence[Column]) -> Column:
    """True if any condition is true; null counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def position_struct(lsn: Column | str, seq: Column | str) -> Column:
    """The pair that orders a feed; compares lsn first, then seq (null lowest)."""
    return F.struct(_col(lsn).alias("lsn"), _col(seq).alias("seq"))


def blank_to_null(col: Column | str) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(_col(col).cast("string")), F.lit(""))


def join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which null equals null; planned as an equi-join. The keys come once, from the left."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__right_{k}"]) for k in keys])
    return left.join(other, same, how).drop(*[f"__right_{k}" for k in keys])
