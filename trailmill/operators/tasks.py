"""Facts of tasks and of what was recorded for them. Columns that are added replace columns of their name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions import text

#: The names of a task's parameters, by what they are called here, and the kind of task that sets each flag.
PARAMETERS = {"target_obj": "object_target", "destination": "parent_target", "mrecep": "mrecep_target", "toggle_target": "toggle_target"}
NEEDS = {
    "needs_clean": "pick_clean_then_place_in_recep",
    "needs_heat": "pick_heat_then_place_in_recep",
    "needs_cool": "pick_cool_then_place_in_recep",
    "needs_two": "pick_two_obj_and_place",
    "needs_toggle": "look_at_obj_in_light",
}
#: What a demonstration's texts are searched for.
MARKS = {"asks_passwords": ["show_account_passwords"], "completes": ["complete_task"], "pages": ["page_limit", "page_index"]}


def listed_places(view: str) -> Column:
    return text.listed_places(F.col(view))


def with_facts(rows: DataFrame, kind: Column, parameters: Column) -> DataFrame:
    """Adds task_type, four parameters in lower case (missing or null: empty), and a flag for each thing that the kind of task needs. ``parameters``: a variant object."""
    own = {name: F.lower(F.coalesce(F.try_variant_get(parameters, f"$.{key}", "string"), F.lit(""))) for name, key in PARAMETERS.items()}
    task = F.coalesce(kind, F.lit(""))
    return rows.select(*(c for c in rows.columns if c not in {"task_type", *PARAMETERS, *NEEDS}), task.alias("task_type"), *(v.alias(k) for k, v in own.items()), *((task == t).alias(k) for k, t in NEEDS.items()))


def demo_flags(rows: DataFrame, key: str, said: str) -> DataFrame:
    """key and, of all its texts, whether any holds each mark; ``complete_demo``: both the first and the second. A flag is partly aggregated before the shuffle, so no conversation is gathered."""
    held = {name: F.max(F.coalesce(F.contains(F.col(said), F.lit(m[0])) if len(m) == 1 else F.contains(F.col(said), F.lit(m[0])) | F.contains(F.col(said), F.lit(m[1])), F.lit(False))).alias(name) for name, m in MARKS.items()}
    return rows.groupBy(key).agg(*held.values()).withColumn("complete_demo", F.col("asks_passwords") & F.col("completes"))


def winning(rows: DataFrame, won: str, score: str, full: float = 100) -> DataFrame:
    """Adds winning and perfect (a score of ``full`` or more); what is null is neither."""
    return rows.withColumns({"winning": F.coalesce(F.col(won), F.lit(False)), "perfect": F.coalesce(F.col(score) >= full, F.lit(False))})


def current_room(messages: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """key, room: the room that the latest user message names which names any; ``unknown`` where none does. The latest is found by a maximum, partly before the shuffle."""
    room = F.when(F.col(role) == "user", text.room_said(F.col(content)))
    latest = F.max(F.when(room.isNotNull(), F.struct(F.col(turn).alias("at"), room.alias("room"))))
    return messages.groupBy(key).agg(latest.alias("_l")).select(key, F.coalesce("_l.room", F.lit("unknown")).alias("room"))


def first_room(messages: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """key, room: the room that the first user message which names one calls it, in lower case; ``hallway`` where none does."""
    said = F.when((F.col(role) == "user") & F.col(content).rlike(text.NAMED), F.lower(text.strip(F.regexp_extract(content, text.NAMED, 1))))
    earliest = F.min(F.when(said.isNotNull(), F.struct(F.col(turn).alias("at"), said.alias("room"))))
    return messages.groupBy(key).agg(earliest.alias("_f")).select(key, F.coalesce("_f.room", F.lit("hallway")).alias("room"))


def distinct_in_order(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, values: the distinct values of a key in the order in which each first came (nulls are none). Firsts are minima, partly before the shuffle, so a key gathers its distinct values only."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda s: s[value]).alias("values"))
