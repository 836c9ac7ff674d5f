"""Rewards as ordered chains of expressions: the order of additions and factors is part of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def household_penalty(max_repeat: Column, max_nothing_streak: Column, n_nothing: Column, n_actions: Column) -> Column:
    loop = F.when(max_repeat >= 3, 0.7).otherwise(1.0)
    stuck = F.when(max_nothing_streak >= 4, 0.6).otherwise(1.0)
    return loop * stuck * F.greatest(F.lit(0.5), F.lit(1.0) - n_nothing / F.greatest(n_actions, F.lit(1)))


def household(won: Column, took: Column, placed: Column, transformed: Column, toggled: Column, n_actions: Column, penalty: Column, form: Column | float = 1.0) -> Column:
    """A win is worth the penalty factor; else part credit for finished steps, at most 0.9; ten actions without any cost 0.05."""
    part = F.when(placed, F.when(transformed, 0.35).otherwise(0.25)).when(toggled & took, 0.25).when(took, 0.03).otherwise(0.0)
    part = F.when((part == 0.0) & (n_actions >= 10), -0.05).otherwise(part)
    form = form if isinstance(form, Column) else F.lit(form)
    return F.when(won, F.least(F.lit(1.0), penalty)).otherwise(F.least(part * form * penalty, F.lit(0.9)))


def household_form(action: Column, preamble: Column) -> Column:
    """0.3 without an action, 0.7 for over 32 characters before it."""
    return F.when(action.isNull(), 0.3).when(F.length(preamble) > 32, 0.7).otherwise(1.0)


def science(score: Column, n_actions: Column, has_focus: Column, n_repeated: Column) -> Column:
    r = score / 100.0
    r = F.when(r < 0, F.when(score <= -50, -0.2).otherwise(F.greatest(r, F.lit(-0.1)))).otherwise(r)
    r = F.when(~has_focus & (n_actions >= 10), F.least(r, F.lit(-0.15))).otherwise(r)
    r = F.when((n_actions <= 2) & (r < 0), F.least(r * 1.5, F.lit(-0.1))).otherwise(r)
    r = F.when(n_repeated > 0, r * F.greatest(F.lit(0.3), 1.0 - 0.15 * n_repeated)).otherwise(r)
    return F.greatest(F.least(r, F.lit(1.0)), F.lit(-0.2))


def number_credit(value: Column, truth: Column) -> Column:
    """A quarter for the exact number, less by the relative error."""
    return (1.0 - F.least(F.abs(value - truth) / F.greatest(truth, F.lit(1)), F.lit(1.0))) * 0.25


def nearest_number(text: Column, truth: Column) -> Column:
    """The number in a text that is nearest to ``truth``, the first on ties; null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))
    ranked = F.array_sort(F.transform(F.filter(found, lambda n: n.isNotNull()), lambda n, i: F.struct(F.abs(n - truth).alias("d"), i.alias("i"), n.alias("n"))))
    return F.get(ranked, F.lit(0))["n"]


def app_question(completed: Column, contained: Column, numeric: Column, value: Column, truth: Column, has_data: Column, has_call: Column, has_success: Column | None = None) -> Column:
    """Credit for an answer before the factors: 1 if it is contained, by nearness for numbers, less for data seen only, and for words still less without a success (none given: there is one)."""
    seen = F.when(has_data, 0.15)
    worded = seen.otherwise(0.08) if has_success is None else seen.when(has_success, 0.08).when(has_call, 0.03).otherwise(0.0)
    return (
        F.when(~completed, seen.when(has_call, 0.03).otherwise(0.0))
        .when(contained, 1.0)
        .when(numeric, F.greatest(F.coalesce(number_credit(value, truth), F.lit(0.0)), seen.otherwise(0.0)))
        .otherwise(worded)
    )


def app_factors(r: Column, invalid_ratio: Column, used_password: Column, placeholder: Column, schema_args: Column, form: Column, completed: Column) -> Column:
    r = r * F.greatest(F.lit(0.1), 1.0 - invalid_ratio)
    for condition, factor in ((~used_password, 0.1), (placeholder, 0.2), (schema_args, 0.3), (completed, form)):
        r = r * F.when(condition, factor).otherwise(1.0)
    return r


def app_action(c: dict[str, Column]) -> Column:
    """An action task. ``c``: calls, repeated, responses, successes, data, password, credentials, placeholder, schema_args,
    invalid_ratio, completed, final_call, preamble, acted, mismatch, form; and where they are not the same as calls, names (how many tools were named) and called
    (whether anything was)."""
    names, called = c.get("names", c["calls"]), c.get("called", c["calls"] > 0)
    has, done, success = c["responses"] > 0, c["completed"], c["successes"] > 0

    def factor(condition: Column, by) -> Column:
        return F.when(condition, by).otherwise(1.0)

    r = F.when(has, 0.6 * c["successes"] / c["responses"] + F.when(c["data"] > 0, 0.1).otherwise(0.0)).otherwise(0.05)
    r = r * factor((c["calls"] > 2) & (c["repeated"] / F.greatest(c["calls"], F.lit(1)) > 0.5), 0.5) * factor(~c["password"] & has, 0.1)
    r = r + F.when(c["credentials"], 0.2).otherwise(0.0)
    r = r * factor(c["placeholder"], 0.2) * factor(c["schema_args"], 0.3) * F.greatest(F.lit(0.1), 1.0 - c["invalid_ratio"])
    r = r * factor(~done & has, F.when(~c["final_call"], 0.3).when(c["preamble"] > 50, 0.5).otherwise(1.0))
    r = r * factor(~done, F.when(c["acted"] & (names >= 8), 0.7).otherwise(0.5)) + F.when(done, F.when(c["acted"] & success, 0.3).when(success, 0.1).otherwise(0.05)).otherwise(0.0)
    r = r * factor(c["mismatch"], 0.3) * factor(done, c["form"])
    return F.when(~called, 0.0).otherwise(F.least(r, F.lit(1.0)))
