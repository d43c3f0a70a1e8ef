from __future__ import annotations

import pytest

from changefeed.operators import rules as R
from changefeed.spec import Condition, Rule
from tests.conftest import rows

LABEL = Rule(
    "label",
    "conditional_column",
    [Condition("priority > 3", "'high'"), Condition("priority > 1", "'medium'")],
    "label",
    on_no_match="default",
    default="'low'",
)
CLASSES = Rule(
    "classes", "row_multiplier", [Condition("patient", "'Patient'"), Condition("ansatt", "'Ansatt'")], "class", stage="source"
)
ACTIVE = Rule("active", "filter", [Condition("status = 'active'"), Condition("status = 'pending'")])


@pytest.fixture
def people(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(
        [(1, 5, True, True, "active"), (2, 2, False, True, None), (3, None, False, None, "pending"), (4, 0, None, False, "closed")],
        "id int, priority int, patient boolean, ansatt boolean, status string",
    )


def test_first_match_wins_and_null_is_no_match(people):
    assert rows(R.conditional_column(people, LABEL), "id", "label") == [(1, "high"), (2, "medium"), (3, "low"), (4, "low")]


def test_no_match_can_drop_or_keep(people):
    drop = Rule("d", "conditional_column", [Condition("priority > 1", "'x'")], "o", on_no_match="drop")
    keep = Rule("k", "conditional_column", [Condition("priority > 1", "'x'")], "o", on_no_match="keep")
    assert rows(R.conditional_column(people, drop), "id", "o") == [(1, "x"), (2, "x")]
    assert rows(R.conditional_column(people, keep), "id", "o") == [(1, "x"), (2, "x"), (3, None), (4, None)]


def test_every_match_gives_a_row(people):
    assert rows(R.row_multiplier(people, CLASSES), "id", "class") == [(1, "Ansatt"), (1, "Patient"), (2, "Ansatt")]


def test_a_matched_null_value_still_gives_a_row(people):
    nulls = Rule("n", "row_multiplier", [Condition("patient", "cast(null as string)")], "class")
    assert rows(R.row_multiplier(people, nulls), "id", "class") == [(1, None)]


def test_multiplied_rows_need_the_output_in_their_key(people):
    with pytest.raises(ValueError, match="must be one of the keys"):
        R.row_multiplier(people, CLASSES, keys=["id"])
    assert R.row_multiplier(people, CLASSES, keys=["id", "class"]).count() == 3


def test_filter_keeps_any_match(people):
    assert rows(R.rule_filter(people, ACTIVE), "id") == [(1,), (3,)]


def test_rules_run_in_order_once_and_by_stage(people):
    sink = Rule("late", "filter", [Condition("false")], stage="sink")
    out = R.run_rules(people, iter([ACTIVE, LABEL, ACTIVE, sink]))
    assert rows(out, "id", "label") == [(1, "high"), (3, "low")]


def test_route_rules_touch_only_their_route(spark, people):
    from pyspark.sql import functions as F

    routed = people.withColumns({"__routing_schema": F.lit("t"), "__routing_table": F.when(F.col("id") < 3, "a")})
    split = Rule("s", "row_multiplier", CLASSES.conditions, "class", stage="sink")
    only = Rule("o", "filter", [Condition("id = 2")], stage="sink")
    out = R.run_route_rules(routed, {("t", "a"): [split, only]})
    assert rows(out, "id", "class") == [(2, "Ansatt"), (3, None), (4, None)]


def test_unknown_names_list_the_choices():
    registry = R.RuleRegistry([LABEL, ACTIVE])
    with pytest.raises(KeyError, match="active, label"):
        registry.rule("nope")
    with pytest.raises(KeyError, match="unknown expression"):
        registry.expression("nope")


@pytest.mark.parametrize(
    "rule",
    [
        Rule("r", "conditional_column", [], "o"),
        Rule("r", "conditional_column", [Condition("true", "1")]),
        Rule("r", "conditional_column", [Condition("true")], "o"),
        Rule("r", "conditional_column", [Condition("true", "1")], "o", on_no_match="default"),
        Rule("r", "row_multiplier", [Condition("true", "1")], "o", on_no_match="default"),
        Rule("r", "filter", [Condition("true")], on_no_match="explode"),
        Rule("r", "other", [Condition("true")]),
    ],
)
def test_bad_rules_are_errors(people, rule):
    with pytest.raises(ValueError, match="rule"):
        R.apply_rule(people, rule)


def test_rules_from_a_catalog(people):
    registry = R.RuleRegistry.from_dicts(
        {"keep_one": {"type": "filter", "conditions": [{"when": "id = 1"}]}}
    )
    assert rows(registry.apply(people, ["keep_one"]), "id") == [(1,)]


def test_route_rules_grow_with_distinct_rules_not_with_routes(spark, people):
    from pyspark.sql import functions as F

    routed = people.withColumns({"__routing_schema": F.concat(F.lit("it's "), F.col("id") % 2), "__routing_table": F.lit("a")})
    split = Rule("s", "row_multiplier", CLASSES.conditions, "class", stage="sink")
    label = Rule("l", "conditional_column", LABEL.conditions, "label", on_no_match="default", default="'low'", stage="sink")
    only = Rule("o", "filter", [Condition("label = 'low'")], stage="sink")
    shared = {(f"s{i}", "t"): [label, split] for i in range(200)}
    rules = {("it's 0", "a"): [label, only], ("it's 1", "a"): [split, label], **shared}
    out = R.run_route_rules(routed, rules)
    assert rows(out, "id", "class", "label") == [(1, "Ansatt", "high"), (1, "Patient", "high"), (4, None, "low")]
    small = R.run_route_rules(routed, dict(list(rules.items())[:3]))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(out) == size(small)


def test_plans_check_the_keys_of_row_multipliers(spark, people):
    split = Rule("s", "row_multiplier", CLASSES.conditions, "class")
    sink = Rule("s", "row_multiplier", CLASSES.conditions, "class", stage="sink")
    with pytest.raises(ValueError, match="must be one of the keys"):
        R.run_rules(people, [split], keys=["id"])
    assert R.run_rules(people, [split], keys=["id", "class"]).count() == 3
    with pytest.raises(ValueError, match="must be one of the keys"):
        R.run_route_rules(people, {("a", "b"): [sink]}, keys_by_route={("a", "b"): ["id"]})
