"""Declarative row rules: first-match columns, row multipliers, filters.

Conditions and values are Spark SQL text. A null condition is no match.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.functions.expressions import any_of
from changefeed.spec import Condition, Rule

# --- Fixed values -----------------------------------------------------------
RULE_KINDS = ("conditional_column", "row_multiplier", "filter")
NO_MATCH = ("drop", "keep", "default")
# --- End of fixed values ----------------------------------------------------


def _check(rule: Rule, kind: str) -> None:
    if rule.kind != kind:
        raise ValueError(f"rule {rule.name!r} is a {rule.kind}, not a {kind}")
    if not rule.conditions:
        raise ValueError(f"rule {rule.name!r} has no conditions")
    if rule.on_no_match not in NO_MATCH:
        raise ValueError(f"rule {rule.name!r}: unknown on_no_match {rule.on_no_match!r}")
    if kind != "filter" and not rule.output:
        raise ValueError(f"rule {rule.name!r} needs an output column")
    if kind != "filter" and any(c.value is None for c in rule.conditions):
        raise ValueError(f"rule {rule.name!r}: every condition needs a value")


def _conditions(rule: Rule) -> list[Column]:
    return [F.expr(c.when) for c in rule.conditions]


def _previous(df: DataFrame, rule: Rule) -> Column:
    """What the output column held before, for rows a rule does not act on."""
    held = F.col(f"`{rule.output}`") if rule.output in df.columns else F.lit(None)
    return held.cast(rule.output_type)


def conditional_column(df: DataFrame, rule: Rule, here: Column | None = None) -> DataFrame:
    """Add a column by the first condition that holds.

    Without a match the row is dropped, kept with null, or takes the default. ``here`` limits the rule to some
    rows; the others pass with what the column held, or null.
    """
    _check(rule, "conditional_column")
    if rule.on_no_match == "default" and rule.default is None:
        raise ValueError(f"rule {rule.name!r} needs a default value")
    chain = None
    for c in rule.conditions:
        chain = (F.when if chain is None else chain.when)(F.expr(c.when), F.expr(c.value))
    value = (chain.otherwise(F.expr(rule.default)) if rule.on_no_match == "default" else chain).cast(rule.output_type)
    kept = any_of(_conditions(rule))
    if here is not None:
        value, kept = F.when(here, value).otherwise(_previous(df, rule)), ~here | kept
    rows = df.filter(kept) if rule.on_no_match == "drop" else df
    return rows.withColumn(rule.output, value)


def _check_keys(rule: Rule, keys: Sequence[str] | None) -> None:
    if keys is not None and rule.kind == "row_multiplier" and rule.output not in keys:
        raise ValueError(f"rule {rule.name!r}: {rule.output!r} must be one of the keys {list(keys)}")


def row_multiplier(df: DataFrame, rule: Rule, keys: Sequence[str] | None = None, here: Column | None = None) -> DataFrame:
    """One output row per condition that holds; without any the row is dropped or kept with null.

    When ``keys`` are given they must contain the output column: otherwise a later merge
    would fold the copies back into one row. Rows that ``here`` leaves out pass once.
    """
    _check(rule, "row_multiplier")
    if rule.on_no_match == "default":
        raise ValueError(f"rule {rule.name!r}: a row multiplier drops or keeps")
    _check_keys(rule, keys)
    hits = F.array_compact(
        F.array(*[F.when(F.expr(c.when), F.struct(F.expr(c.value).cast(rule.output_type).alias("v"))) for c in rule.conditions])
    )
    if here is not None:
        hits = F.when(here, hits).otherwise(F.array(F.struct(_previous(df, rule).alias("v"))))
    spread = F.explode_outer if rule.on_no_match == "keep" else F.explode
    return df.select("*", spread(hits).alias("__hit")).withColumn(rule.output, F.col("__hit.v")).drop("__hit")


def rule_filter(df: DataFrame, rule: Rule, here: Column | None = None) -> DataFrame:
    """Keep a row if any condition holds, or if ``here`` leaves it out."""
    _check(rule, "filter")
    kept = any_of(_conditions(rule))
    return df if rule.on_no_match == "keep" else df.filter(kept if here is None else ~here | kept)


APPLY = {
    "conditional_column": conditional_column,
    "row_multiplier": row_multiplier,
    "filter": rule_filter,
}


def apply_rule(df: DataFrame, rule: Rule, keys: Sequence[str] | None = None, here: Column | None = None) -> DataFrame:
    """Apply one rule by its kind. ``keys`` are those of the table the rows will be merged into."""
    if rule.kind not in APPLY:
        raise ValueError(f"unknown rule kind {rule.kind!r}; known: {', '.join(RULE_KINDS)}")
    _check_keys(rule, keys)
    return APPLY[rule.kind](df, rule, here=here)


def run_rules(df: DataFrame, rules: Iterable[Rule], stage: str = "source", keys: Sequence[str] | None = None) -> DataFrame:
    """Apply the rules of one stage in order; a rule listed twice runs once."""
    ordered: dict[str, Rule] = {}
    for rule in rules:
        if rule.stage == stage:
            ordered.setdefault(rule.name, rule)
    return reduce(lambda rows, rule: apply_rule(rows, rule, keys), ordered.values(), df)


def _content(rule: Rule) -> tuple:
    """What makes two rules the same rule."""
    return (rule.name, rule.kind, tuple((c.when, c.value) for c in rule.conditions), rule.output, rule.output_type, rule.on_no_match, rule.default)


def run_route_rules(
    df: DataFrame,
    rules_by_route: Mapping[tuple[str, str], Sequence[Rule]],
    schema: str = "__routing_schema",
    table: str = "__routing_table",
    keys_by_route: Mapping[tuple[str, str], Sequence[str]] | None = None,
) -> DataFrame:
    """Apply sink-stage rules per route; rows of other routes pass unchanged.

    Routes that list the same rules share a rule set. Rows get the number of their set by one join with the routes,
    and each distinct rule is applied once, to the rows of all sets whose turn it is. So the plan grows with the
    distinct rules, not with the routes. ``keys_by_route`` has the keys of the tables behind the routes, which
    row multipliers are checked against.
    """
    sets: dict[tuple, int] = {}
    known: dict[tuple, Rule] = {}
    numbers = []
    for route, rules in rules_by_route.items():
        sink = [r for r in rules if r.stage == "sink"]
        for rule in sink:
            _check_keys(rule, keys_by_route.get(route) if keys_by_route else None)
            known[_content(rule)] = rule
        if sink:
            numbers.append((*route, sets.setdefault(tuple(_content(r) for r in sink), len(sets))))
    if not sets:
        return df
    ends = ["__rule_schema", "__rule_table"]
    routes = df.sparkSession.createDataFrame(numbers, f"{ends[0]} string, {ends[1]} string, __rule_set int")
    on = (F.col(f"`{schema}`") == F.col(ends[0])) & (F.col(f"`{table}`") == F.col(ends[1]))
    out = df.join(routes, on, "left").drop(*ends)
    left = {number: list(rules) for rules, number in sets.items()}
    while any(left.values()):
        # The rule that most sets have next; ties go to the set numbered first.
        turns: dict[tuple, list[int]] = {}
        for number, rules in left.items():
            if rules:
                turns.setdefault(rules[0], []).append(number)
        content = max(turns, key=lambda c: len(turns[c]))
        here = F.coalesce(F.col("__rule_set").isin(turns[content]), F.lit(False))
        out = apply_rule(out, known[content], here=here)
        for number in turns[content]:
            left[number].pop(0)
    return out.drop("__rule_set")


class RuleRegistry:
    """Named rules and named expressions, looked up by name."""

    def __init__(self, rules: Iterable[Rule] = (), expressions: Mapping[str, str] | None = None) -> None:
        self._rules = {r.name: r for r in rules}
        self._expressions = dict(expressions or {})

    @classmethod
    def from_dicts(cls, catalog: Mapping[str, Mapping[str, object]]) -> RuleRegistry:
        """Rules from plain dictionaries, as a catalog file would hold them."""
        rules = []
        for name, item in catalog.items():
            out = item.get("output_column") or {}
            rules.append(
                Rule(
                    name=name,
                    kind=str(item["type"]),
                    conditions=[Condition(c["when"], c.get("value")) for c in item["conditions"]],
                    output=out.get("name"),
                    output_type=out.get("type", "string"),
                    on_no_match=str(item.get("on_no_match", "drop")),
                    default=item.get("default_value"),
                    stage=str(item.get("stage", "source")),
                )
            )
        return cls(rules)

    def register(self, rule: Rule) -> None:
        self._rules[rule.name] = rule

    def register_expr(self, name: str, sql: str) -> None:
        """Give a Spark SQL expression a name."""
        self._expressions[name] = sql

    def rule(self, name: str) -> Rule:
        if name not in self._rules:
            raise KeyError(f"unknown rule {name!r}; known: {', '.join(sorted(self._rules))}")
        return self._rules[name]

    def expression(self, name: str) -> Column:
        if name not in self._expressions:
            raise KeyError(f"unknown expression {name!r}; known: {', '.join(sorted(self._expressions))}")
        return F.expr(self._expressions[name])

    def apply(self, df: DataFrame, names: Sequence[str], stage: str = "source") -> DataFrame:
        """Apply named rules in order."""
        return run_rules(df, [self.rule(n) for n in names], stage)

    def with_expressions(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Add one column per named expression."""
        return df.withColumns({n: self.expression(n) for n in names})
