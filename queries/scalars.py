"""Scalar functions of mappings (L1-L11): Spark built-ins, used as named expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import idempotency_key
from changefeed.operators.rules import RuleRegistry
from queries.base import Tables, query


def _named(df: DataFrame, keep: list[str], expressions: Mapping[str, str]) -> DataFrame:
    registry = RuleRegistry(expressions=expressions)
    return registry.with_expressions(df, list(expressions)).select(*keep, *expressions)


@query(
    "l1_strings",
    """select doc_id, upper(source) as up, lower(lang) as low, trim(concat('  ', lang, ' ')) as trimmed, starts_with(text, 'A') as starts, ends_with(trim(text), '.') as finishes,
    length(text) as chars, contains(text, 'the') as has_the, instr(text, 'e') as first_e, len(string_split(text, ' ')) as words, replace(source, 'e', '3') as swapped, substring(text, 3, 5) as cut,
    lpad(cast(doc_id as varchar), 8, '0') as padded, repeat(lang, 2) as twice, replace(replace(replace(source || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html, printf('%s-%05d', lang, doc_id) as formatted, reverse(lang) as backwards from {documents}""",
)
def _(t: Tables) -> DataFrame:
    return _named(
        t("documents"),
        ["doc_id"],
        {
            "up": "upper(source)",
            "low": "lower(lang)",
            "trimmed": "trim(concat('  ', lang, ' '))",
            "starts": "startswith(text, 'A')",
            "finishes": "endswith(trim(text), '.')",
            "chars": "cast(char_length(text) as bigint)",
            "has_the": "contains(text, 'the')",
            "first_e": "cast(instr(text, 'e') as bigint)",
            "words": "cast(size(split(text, ' ', -1)) as bigint)",
            "swapped": "replace(source, 'e', '3')",
            "cut": "substring(text, 3, 5)",
            "padded": "lpad(cast(doc_id as string), 8, '0')",
            "twice": "repeat(lang, 2)",
            "html": "replace(replace(replace(source || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
            "formatted": "format_string('%s-%05d', lang, doc_id)",
            "backwards": "reverse(lang)",
        },
    )


@query(
    "l2_regex",
    """select page_id, regexp_matches(url, '/[a-z]{{2}}/') as has_lang, len(regexp_extract_all(url, '[0-9]+')) as numbers, regexp_extract(url, '^https?://([^/]+)', 1) as host,
    regexp_replace(url, '[0-9]+', '#', 'g') as masked, len(regexp_extract_all(html, '<[a-z0-9]+')) as tags from {pages}""",
)
def _(t: Tables) -> DataFrame:
    return _named(
        t("pages"),
        ["page_id"],
        {
            "has_lang": "url rlike '/[a-z]{2}/'",
            "numbers": "cast(size(regexp_extract_all(url, '[0-9]+', 0)) as bigint)",
            "host": "regexp_extract(url, '^https?://([^/]+)', 1)",
            "masked": "regexp_replace(url, '[0-9]+', '#')",
            "tags": "cast(size(regexp_extract_all(html, '<[a-z0-9]+', 0)) as bigint)",
        },
    )


@query(
    "l3_numbers",
    """select c_custkey, abs(c_acctbal) as magnitude, cast(ceil(c_acctbal) as bigint) as up, cast(floor(c_acctbal) as bigint) as down, greatest(0.0::double, least(1000.0::double, c_acctbal)) as clamped,
    round(pow(c_nationkey, 2), 3) as squared, round(ln(abs(c_acctbal) + 1), 6) as natural, round(log10(abs(c_acctbal) + 1), 6) as decimal_log,
    try_cast(c_mktsegment as bigint) as not_a_number, try_cast(cast(c_custkey as varchar) as integer) as number, case when c_nationkey between 0 and 255 then cast(c_nationkey as smallint) end as unsigned_byte from {customer}""",
)
def _(t: Tables) -> DataFrame:
    return _named(
        t("customer"),
        ["c_custkey"],
        {
            "magnitude": "abs(c_acctbal)",
            "up": "ceil(c_acctbal)",
            "down": "floor(c_acctbal)",
            "clamped": "greatest(0.0D, least(1000.0D, c_acctbal))",
            "squared": "round(pow(c_nationkey, 2), 3)",
            "natural": "round(ln(abs(c_acctbal) + 1), 6)",
            "decimal_log": "round(log10(abs(c_acctbal) + 1), 6)",
            "not_a_number": "try_cast(c_mktsegment as bigint)",
            "number": "try_cast(cast(c_custkey as string) as int)",
            "unsigned_byte": "case when c_nationkey between 0 and 255 then cast(c_nationkey as smallint) end",
        },
    )


@query(
    "l4_timestamps",
    """select event_id, epoch_us(ts) as micros, cast(floor(epoch_us(ts) / 1000) as bigint) as millis, cast(floor(epoch_us(ts) / 1000000) as bigint) as seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso,
    year(ts) as y, month(ts) as m, day(ts) as d, hour(ts) as h, date_trunc('hour', ts) as hour_start, ts + interval 1 month + interval 2 hour as later,
    try_cast(case when event_id % 2 = 0 then 'not a time' else '2024-02-03 04:05:06' end as timestamp) as parsed, time_bucket(interval 15 minute, ts) as quarter from {events}""",
)
def _(t: Tables) -> DataFrame:
    epoch = "timestamp_ntz'1970-01-01 00:00:00'"
    return _named(
        t("events"),
        ["event_id"],
        {
            "micros": f"timestampdiff(MICROSECOND, {epoch}, ts)",
            "millis": f"timestampdiff(MILLISECOND, {epoch}, ts)",
            "seconds": f"timestampdiff(SECOND, {epoch}, ts)",
            "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
            "y": "cast(year(ts) as bigint)",
            "m": "cast(month(ts) as bigint)",
            "d": "cast(day(ts) as bigint)",
            "h": "cast(hour(ts) as bigint)",
            "hour_start": "cast(date_trunc('hour', ts) as timestamp_ntz)",
            "later": "ts + make_interval(0, 1, 0, 0, 2)",
            "parsed": "try_cast(case when event_id % 2 = 0 then 'not a time' else '2024-02-03 04:05:06' end as timestamp_ntz)",
            "quarter": f"timestampadd(MINUTE, 15 * floor(timestampdiff(MINUTE, {epoch}, ts) / 15), {epoch})",
        },
    )


_WORDS = "string_split(p_name, ' ')"


@query(
    "l5_arrays",
    f"""select p_partkey, {_WORDS}[1] as first_word, {_WORDS}[-1] as last_word, array_to_string(list_slice({_WORDS}, 1, 2), '+') as slice_text,
    array_to_string(list_transform({_WORDS}, lambda w: upper(w)), ' ') as mapped, len(list_filter({_WORDS}, lambda w: length(w) > 4)) as long_words,
    len(list_filter({_WORDS}, lambda w: starts_with(w, 'r'))) > 0 as any_r, len(list_filter({_WORDS}, lambda w: length(w) > 2)) = len({_WORDS}) as all_longer,
    list_sum([p_size, 2, 3])::bigint as total, array_to_string(list_sort(list_distinct([p_brand, p_type, p_brand])), ',') as uniq, array_to_string(list_reverse({_WORDS}), ' ') as reversed,
    array_to_string(list_append({_WORDS}, 'end'), ' ') as appended, array_to_string(list_concat({_WORDS}, [p_type]), ' ') as joined, array_to_string(flatten([{_WORDS}, [p_brand]]), ' ') as flat from {{part}}""",
)
def _(t: Tables) -> DataFrame:
    words = "split(p_name, ' ', -1)"
    return _named(
        t("part"),
        ["p_partkey"],
        {
            "first_word": f"element_at({words}, 1)",
            "last_word": f"element_at({words}, -1)",
            "slice_text": f"array_join(slice({words}, 1, 2), '+')",
            "mapped": f"array_join(transform({words}, w -> upper(w)), ' ')",
            "long_words": f"cast(size(filter({words}, w -> length(w) > 4)) as bigint)",
            "any_r": f"exists({words}, w -> startswith(w, 'r'))",
            "all_longer": f"forall({words}, w -> length(w) > 2)",
            "total": "aggregate(array(p_size, 2, 3), 0L, (a, x) -> a + x)",
            "uniq": "array_join(array_sort(array_distinct(array(p_brand, p_type, p_brand))), ',')",
            "reversed": f"array_join(reverse({words}), ' ')",
            "appended": f"array_join(array_append({words}, 'end'), ' ')",
            "joined": f"array_join(concat({words}, array(p_type)), ' ')",
            "flat": f"array_join(flatten(array({words}, array(p_brand))), ' ')",
        },
    )


@query(
    "l5_enumerate_zip",
    f"select p_partkey, i - 1 as position, {_WORDS}[i] as word, [p_brand, p_type][i] as zipped from {{part}}, unnest(generate_series(1, len({_WORDS}))) u(i)",
)
def _(t: Tables) -> DataFrame:
    zipped = F.arrays_zip(F.split("p_name", " ").alias("word"), F.array("p_brand", "p_type").alias("zipped"))
    rows = t("part").select("p_partkey", F.posexplode(zipped).alias("position", "z"))
    return rows.select("p_partkey", F.col("position").cast("bigint").alias("position"), "z.word", "z.zipped").filter(F.col("word").isNotNull())


@query(
    "l6_objects",
    """select c_custkey, 'name,nation' as keys, concat(c_name, ',', cast(c_nationkey as varchar)) as vals, c_name as name, false as has_email, 'name,nation,segment' as merged_keys, 'nation' as without_name, c_mktsegment as segment, cast(null as varchar) as absent from {customer}""",
)
def _(t: Tables) -> DataFrame:
    row = "map('name', c_name, 'nation', cast(c_nationkey as string))"
    return _named(
        t("customer"),
        ["c_custkey"],
        {
            "keys": f"array_join(array_sort(map_keys({row})), ',')",
            "vals": f"array_join(map_values({row}), ',')",
            "name": f"{row}['name']",
            "has_email": f"map_contains_key({row}, 'email')",
            "merged_keys": f"array_join(array_sort(map_keys(map_concat({row}, map('segment', c_mktsegment)))), ',')",
            "without_name": f"array_join(map_keys(map_filter({row}, (k, v) -> k <> 'name')), ',')",
            "segment": "named_struct('inner', named_struct('segment', c_mktsegment)).inner.segment",
            "absent": f"try_element_at({row}, 'email')",
        },
    )


@query(
    "l7_json",
    """select event_id, cast(json_extract(props, '$.k') as bigint) as k, json_extract_string(props, '$.k') as k_text, json_extract_string(props, '$.none') as none_text,
    event_type as round_trip from {events}""",
)
def _(t: Tables) -> DataFrame:
    return _named(
        t("events"),
        ["event_id"],
        {
            "k": "from_json(props, 'k bigint').k",
            "k_text": "get_json_object(props, '$.k')",
            "none_text": "variant_get(try_parse_json(props), '$.none', 'string')",
            "round_trip": "get_json_object(to_json(named_struct('t', event_type, 'v', value)), '$.t')",
        },
    )


@query(
    "l8_csv_xml_url",
    """select page_id, regexp_extract(url, '^https?://([^/?]+)', 1) as host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) as path, nullif(regexp_extract(url, '[?&]page=([^&]*)', 1), '') as page_param,
    'p' || cast(page_id as varchar) as csv_name, page_id * 2 as xml_value from {pages}""",
)
def _(t: Tables) -> DataFrame:
    return _named(
        t("pages"),
        ["page_id"],
        {
            "host": "try_parse_url(url, 'HOST')",
            "path": "try_parse_url(url, 'PATH')",
            "page_param": "try_parse_url(url, 'QUERY', 'page')",
            "csv_name": "from_csv(concat('p', page_id, ',x'), 'name string, rest string').name",
            "xml_value": "from_xml(concat('<r><v>', page_id * 2, '</v></r>'), 'v bigint').v",
        },
    )


@query(
    "l9_encode_hash",
    """select doc_id, md5(text) as md5_hex, sha1(text) as sha1_hex, sha256(text) as sha256_hex, base64(encode(source)) as b64, lower(hex(source)) as hex_text, decode(from_base64(base64(encode(source)))) as back,
    replace(replace(replace(base64(encode(source)), '+', '-'), '/', '_'), '=', '') as b64url from {documents}""",
)
def _(t: Tables) -> DataFrame:
    return _named(
        t("documents"),
        ["doc_id"],
        {
            "md5_hex": "md5(text)",
            "sha1_hex": "sha1(text)",
            "sha256_hex": "sha2(text, 256)",
            "b64": "base64(encode(source, 'UTF-8'))",
            "hex_text": "lower(hex(source))",
            "back": "decode(unbase64(base64(encode(source, 'UTF-8'))), 'UTF-8')",
            "b64url": "replace(translate(base64(encode(source, 'UTF-8')), '+/', '-_'), '=', '')",
        },
    )


@query("l9_sha512")
def _(t: Tables) -> DataFrame:
    # The other engine has no sha512; a test compares this with a known digest.
    return _named(t("documents"), ["doc_id"], {"sha512_hex": "sha2(text, 512)"})


@query("l10_ids_generators", "select event_id, substring(sha256(cast(event_id as varchar) || event_type), 1, 32) as content_id, n from {events}, unnest(generate_series(cast(0 as bigint), event_id % 3)) s(n)")
def _(t: Tables) -> DataFrame:
    # Random and counter ids differ per run; ids that must repeat come from the content.
    rows = t("events").select(
        "event_id", idempotency_key(["event_id", "event_type"]).alias("content_id"), F.expr("explode(sequence(0L, event_id % 3))").alias("n")
    )
    return rows


@query(
    "l11_null_and_type",
    """select c_custkey, coalesce(case when c_custkey % 2 = 0 then c_name end, 'nobody') as name, try_cast(c_mktsegment as double) as caught, coalesce(try_cast(c_mktsegment as bigint), -1) as or_default,
    case when c_custkey % 4 = 0 then null else 'x' end is not distinct from null as is_null, cast(c_custkey as varchar) as text, case when c_custkey % 3 <> 0 then c_nationkey / (c_custkey % 3) end as quotient, case when try_cast(c_name as bigint) is not null then 'number' else 'string' end as kind from {customer}""",
)
def _(t: Tables) -> DataFrame:
    return _named(
        t("customer"),
        ["c_custkey"],
        {
            "name": "coalesce(case when c_custkey % 2 = 0 then c_name end, 'nobody')",
            "caught": "try_cast(c_mktsegment as double)",
            "or_default": "coalesce(try_cast(c_mktsegment as bigint), -1L)",
            "is_null": "case when c_custkey % 4 = 0 then null else 'x' end <=> null",
            "text": "cast(c_custkey as string)",
            "quotient": "try_divide(c_nationkey, c_custkey % 3)",
            "kind": "case when try_cast(c_name as bigint) is not null then 'number' else 'string' end",
        },
    )
