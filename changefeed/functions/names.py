"""Names as data: filters, identifier extraction, feed names, table selection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from fnmatch import translate as glob_to_regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import _col, any_of, join_nulls, lookup, safe_identifier
from changefeed.spec import DEFAULT_SCHEMA

# --- Fixed values -----------------------------------------------------------
REGEX_CHARACTERS = ".^$*+?{}[]\\|()"
FEED_SUFFIX = "_CT"
ENV_SUFFIXES = ("_dev", "_prod", "_test", "_staging")
SERVICE_SEPARATOR = "_db_"
# --- End of fixed values ----------------------------------------------------


def _is_regex(pattern: str) -> bool:
    if not any(ch in REGEX_CHARACTERS for ch in pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def name_matches(col: Column | str, patterns: Sequence[str], when_empty: bool = False) -> Column:
    """Whether a name matches any pattern, without case.

    A pattern with regex characters is searched as a regex, any other (and an invalid
    regex) as a substring. Blank patterns never match; ``when_empty`` answers for an
    empty list.
    """
    name = _col(col)
    tests = []
    for pattern in (p.strip() for p in patterns):
        if not pattern:
            continue
        if _is_regex(pattern):
            tests.append(name.rlike("(?i)" + pattern))
        else:
            tests.append(F.lower(name).contains(pattern.lower()))
    if not tests:
        return F.lit(when_empty if not patterns else False)
    return any_of(tests)


def glob_matches(col: Column | str, pattern: str | None) -> Column:
    """Whether a name matches a shell-style glob; no pattern matches everything."""
    if not pattern:
        return F.lit(True)
    # fnmatch writes the end anchor the Python way; Java spells it \z.
    return _col(col).rlike("^" + glob_to_regex(pattern).replace("\\Z", "\\z"))


@dataclass(frozen=True)
class NamePattern:
    """One extraction pattern with named groups ``service`` and, maybe, ``env``."""

    pattern: str
    env: str | None = None
    strip: Sequence[str] = ()
    env_mapping: Mapping[str, str] = field(default_factory=dict)


def _java_regex(pattern: str) -> str:
    return "^(?:" + pattern.replace("(?P<", "(?<") + ")"


def _group(name: Column, pattern: str, group: str) -> Column:
    groups = re.compile(pattern).groupindex
    if group not in groups:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(name, _java_regex(pattern), groups[group]), F.lit(""))


def extract_service_env(name: Column | str, server: Column | str, patterns: Sequence[NamePattern]) -> Column:
    """Struct (service, env) by the first pattern that matches and captures a service; else null.

    A fixed environment beats a captured one, which beats the server name. A pattern whose
    fixed environment does not occur in its own regex is skipped.
    """
    name, server = _col(name), _col(server)
    candidates = []
    for p in patterns:
        if not p.pattern or (p.env and p.env not in p.pattern):
            continue
        service = _group(name, p.pattern, "service")
        env = F.coalesce(F.lit(p.env), _group(name, p.pattern, "env"), server)
        if p.env_mapping:
            env = F.coalesce(lookup(p.env_mapping, env), env)
        stripped = service
        for junk in p.strip:
            stripped = F.regexp_replace(stripped, junk, "")
        hit = name.rlike(_java_regex(p.pattern)) & service.isNotNull()
        candidates.append(F.when(hit, F.struct(stripped.alias("service"), env.alias("env"))))
    if not candidates:
        return F.lit(None).cast("struct<service:string,env:string>")
    return F.coalesce(*candidates)


def extract_identifiers(
    df: DataFrame,
    mode: str,
    patterns: Sequence[NamePattern] = (),
    single: str | None = None,
    overrides: Mapping[str, str] | None = None,
    group: str = "",
    name: str = "db_name",
    server: str = "server",
) -> DataFrame:
    """Add customer, service and env found in each database name.

    ``shared``: ordered patterns, then the single pattern (needs both groups), then the
    name itself with the server as environment. ``per_tenant``: the override map, then the
    single pattern's ``customer`` group, then the name itself.
    """
    n, s = F.col(name), F.col(server)
    if mode == "shared":
        found = extract_service_env(n, s, patterns)
        if single:
            service, env = _group(n, single, "service"), _group(n, single, "env")
            both = service.isNotNull() & env.isNotNull()
            found = F.coalesce(found, F.when(both, F.struct(service.alias("service"), env.alias("env"))))
        found = F.coalesce(found, F.struct(n.alias("service"), s.alias("env")))
        return df.withColumn("__id", found).select(
            "*", F.lit("").alias("customer"), F.col("__id.service").alias("service"), F.col("__id.env").alias("env")
        ).drop("__id")
    if mode == "per_tenant":
        named = {k: v.strip() for k, v in (overrides or {}).items() if v.strip()}
        captured = _group(n, single, "customer") if single else F.lit(None).cast("string")
        return df.select(
            "*",
            F.coalesce(lookup(named, n), captured, n).alias("customer"),
            F.lit(group).alias("service"),
            F.coalesce(F.nullif(s, F.lit("")), F.lit("default")).alias("env"),
        )
    raise ValueError(f"mode must be 'shared' or 'per_tenant', not {mode!r}")


def infer_service(name: Column | str) -> Column:
    """Service by the naming habit ``{service}_db_{env}``; one environment suffix is dropped first."""
    n = F.regexp_replace(_col(name), "(?:" + "|".join(ENV_SUFFIXES) + ")$", "")
    parts = F.split(n, SERVICE_SEPARATOR)
    second = F.nullif(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return F.lower(F.coalesce(second, F.element_at(parts, 1)))


def feed_name(df: DataFrame, schema: str = "schema_name", table: str = "table_name") -> DataFrame:
    """Add ``feed_name``: the table, led by its schema unless that is the default and the name is unique.

    Name counts come from an aggregate joined back, so a name shared by very many schemas
    is counted map-side instead of being sorted in one task.
    """
    folded = F.lower(F.col(table))
    counts = df.groupBy(folded.alias("__folded")).agg(F.count("*").alias("__same_name"))
    bare = safe_identifier(table)
    full = F.concat(safe_identifier(schema), F.lit("_"), bare)
    keep_bare = (F.col("__same_name") == 1) & (F.lower(F.col(schema)) == DEFAULT_SCHEMA)
    return (
        join_nulls(df.withColumn("__folded", folded), counts, ["__folded"])
        .withColumn("feed_name", F.concat(F.when(keep_bare, bare).otherwise(full), F.lit(FEED_SUFFIX)))
        .drop("__folded", "__same_name")
    )


def select_tables(
    df: DataFrame,
    tracked: Sequence[str] = (),
    ignored: Sequence[str] = (),
    schema: str = "schema_name",
    table: str = "table_name",
) -> DataFrame:
    """Tables that are tracked and not ignored, without case.

    An empty tracked list means all. Entries are ``table`` or ``schema.table``; a bare
    tracked name fits any schema, a bare ignored name only the default schema.
    """
    t = F.lower(F.trim(F.col(table)))
    full = F.concat_ws(".", F.lower(F.trim(F.col(schema))), t)
    out = df
    wanted = [x.strip().lower() for x in tracked if x.strip()]
    if wanted:
        out = out.filter(full.isin(*wanted) | t.isin(*wanted))
    dropped = [x.strip().lower() for x in ignored if x.strip()]
    if dropped:
        out = out.filter(~full.isin(*[x if "." in x else f"{DEFAULT_SCHEMA}.{x}" for x in dropped]))
    return out
