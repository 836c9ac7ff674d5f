"""App rollouts: what the texts of a trajectory say was called, answered and finished, and the reward for it.

A rollout is its messages (assistant texts with calls, tool or user texts with tool responses), and a row with the last completion, the instruction
and the true answer. Calls are read from texts; nothing is taken as a ready flag. Null texts say nothing. A rollout without messages has its completion only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.functions.jsonx import tool_call_parts
from trailmill.functions.text import drop_think, strip
from trailmill.operators import apps, rewards, trajectory

PASSWORDS, COMPLETE = "show_account_passwords", "supervisor__complete_task"
#: What an argument holds that was made up, in lower case.
MADE_UP = [
    "your_", "user's ", "your ", "my_", "user_",
    "{'type':", '{"type":', "new_playlist_id",
    "roommate1", "roommate2", "bill_amount",
    "your_username", "your_password", "your_venmo",
    "your_spotify", "user's spotify",
    "colleague_username", "colleague1", "correct_email@",
]
#: Tools that only ask.
ASKING = [
    "supervisor__show_account_passwords", "supervisor__complete_task",
    "spotify__login", "spotify__show_playlist_library", "spotify__show_playlist",
    "spotify__show_liked_songs", "spotify__show_song_library", "spotify__show_album",
    "spotify__show_album_library", "spotify__show_recommendations", "spotify__search_songs",
    "spotify__show_artist",
    "venmo__login", "venmo__show_transactions", "venmo__show_received_payment_requests",
    "venmo__show_social_feed",
    "phone__login", "phone__search_text_messages", "phone__search_voice_messages",
    "file_system__login", "file_system__show_directory", "file_system__show_file",
    "simple_note__login", "simple_note__search_notes",
]
#: Words of an instruction, and parts of tools' names that go against them.
AGAINST = [(["reject", "deny", "decline"], ["accept"]), (["delete", "remove"], ["add", "create", "like"]), (["unlike", "unfollow"], ["like", "follow"]), (["unfollow"], ["follow_artist"])]

CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("values", T.ArrayType(T.StringType())), T.StructField("answer", T.StringType())])


@F.pandas_udf(CALL)
def call_in(text: pd.Series) -> pd.DataFrame:
    """Name, values of the arguments as texts, and the argument ``answer`` of the call in a text; nulls where there is none."""
    made = []
    for name, args in map(tool_call_parts, text):
        made.append((name, None if name is None else [str(v) for v in args.values()], None if name is None else str(args.get("answer", ""))))
    return pd.DataFrame(made, columns=["name", "values", "answer"])


def holds_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return F.coalesce(found, F.lit(False))


def form_of(completion: Column, called: Column) -> Column:
    """The factor for how a completion is written: fences and tags, the other name of arguments, words before the call; 0 without a call."""
    text = drop_think(completion)
    own = F.startswith(text, F.lit("[TOOL_CALLS]")) | F.contains(text, F.lit("<|tool_call_start|>"))
    fenced = F.when(holds_any(text, ["```", "<tool_call>", "<|tool|>", "<|/tool|>"]), 0.4).otherwise(1.0)
    named = F.when(~own & F.contains(text, F.lit('"arguments"')) & ~F.contains(text, F.lit('"parameters"')), 0.7).otherwise(1.0)
    bare = F.when(~own & ~text.rlike(r"\A[\[{]"), 0.4).otherwise(1.0)
    return F.when(called, fenced * named * bare).otherwise(0.0)


def preamble_of(completion: Column) -> Column:
    """Characters before the last bracket of a completion, stripped; 0 where there is none."""
    text = drop_think(completion)
    return F.length(strip(F.regexp_extract(text, r"(?s)\A(.*)[\[{]", 1)))


def facts(messages: DataFrame, ends: DataFrame, catalogue: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """A row for each of ``ends`` (key, completion, instruction, truth) with what its messages say.

    Windows over one order of a trajectory tell what came before a message; all else is counted, partly before the shuffle.
    """
    order = W.partitionBy(key).orderBy(turn)
    said, text = F.col(role) == "assistant", F.coalesce(F.col(content), F.lit(""))
    answered = F.col(role).isin("user", "tool") & F.contains(text, F.lit("<tool_response>"))
    inner = r"(?s)<tool_response>\s*(.*?)\s*</tool_response>"
    response = F.when(answered, F.when(text.rlike(inner), F.regexp_extract(text, inner, 1)).otherwise(text))
    rows = messages.select(key, turn, F.when(said, call_in(F.when(said, drop_think(text)))).alias("call"), response.alias("response"), F.last(F.when(said, text), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("asked"))
    gave = F.when(F.contains("asked", F.lit(PASSWORDS)), F.col("response"))
    rows = rows.withColumn("known", F.last(gave, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    values = F.lower(F.array_join("call.values", " "))
    real = F.contains("call.name", F.lit("login")) & (F.coalesce(F.col("known"), F.lit("")) != "") & F.exists("call.values", lambda v: (F.length(v) > 3) & F.contains(F.col("known"), v))
    kind = F.when(F.col("response").isNotNull(), trajectory.response_class(F.col("response")))
    asked = F.when(F.col("response").isNotNull() & (F.col("asked") != ""), F.left(F.col("asked"), F.lit(200)))
    name = F.col("call.name")
    told = rows.groupBy(key).agg(
        F.count("response").alias("responses"), F.count_if(kind.isin("success", "data")).alias("successes"), F.count_if(kind == "data").alias("data"),
        F.count(asked).alias("calls"), (F.count(asked) - F.count_distinct(asked)).alias("repeated"), F.max(F.coalesce(real, F.lit(False))).alias("credentials"),
        F.max(holds_any(values, MADE_UP)).alias("placeholder"), F.count_if(holds_any(values, ["{'type'", '{"type"'])).alias("n_schema"),
        F.collect_set(name).alias("tools"), F.count(name).alias("n_names"), F.max(F.when(name == COMPLETE, F.struct(turn, F.col("call.answer").alias("answer")))).alias("answered"),
    )
    wrong = apps.in_catalogue(rows.where(name.isNotNull()).select(key, name.alias("tool")), "tool", catalogue, "_known").groupBy(key).agg(F.count_if(~F.col("_known")).alias("n_wrong"))
    last = ends.select(key, F.coalesce("completion", F.lit("")).alias("completion"), F.coalesce("instruction", F.lit("")).alias("instruction"), F.coalesce("truth", F.lit("")).alias("truth")).withColumn("final", call_in(drop_think(F.col("completion"))))
    last = apps.in_catalogue(last.withColumn("tool", F.col("final.name")), "tool", catalogue, "_known")
    both = last.join(told, key, "left").join(wrong, key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    final, ended = F.col("final.name").isNotNull(), F.when(F.col("final.name") == COMPLETE, F.col("final.answer"))
    names = F.concat(F.coalesce("tools", F.array().cast("array<string>")), F.when(final, F.array("final.name")).otherwise(F.array().cast("array<string>")))
    count = n("n_names") + final.cast("int")
    against = F.lit(False)
    for words, parts in AGAINST:
        against = against | (holds_any(F.lower("instruction"), words) & holds_any(F.lower(F.array_join(names, "\n")), parts))  # no part spans two names
    return both.select(
        key, *(n(c).alias(c) for c in ("responses", "successes", "data", "calls", "repeated")), count.alias("names"), yes(F.col("credentials")).alias("credentials"), yes(F.col("placeholder")).alias("placeholder"), (n("n_schema") > 0).alias("schema_args"),
        ((n("n_wrong") + (final & ~F.col("_known")).cast("int")) / F.greatest(count, F.lit(1))).alias("invalid_ratio"), F.exists(names, lambda t: F.contains(t, F.lit(PASSWORDS))).alias("password"), F.exists(names, lambda t: ~t.isin(ASKING)).alias("acted"),
        F.array_contains(names, COMPLETE).alias("completed"), F.coalesce(ended, F.col("answered.answer"), F.lit("")).alias("answer"), final.alias("final_call"), F.when(final, preamble_of(F.col("completion"))).otherwise(0).alias("preamble"),
        against.alias("mismatch"), form_of(F.col("completion"), final).alias("form"), "truth",
    )


def app_rewards(told: DataFrame, key: str) -> DataFrame:
    """key, reward of ``facts``: a question's where there is a true answer, else an action's."""
    c = {k: F.col(k) for k in told.columns} | {"called": (F.col("responses") > 0) | F.col("final_call")}
    truth = strip(F.col("truth"))
    number = truth.rlike(r"(?U)\A\d+\z")
    value = F.when(number, rewards.nearest_number(F.col("answer"), truth.try_cast("bigint")))
    contained = F.contains(F.lower("answer"), F.lower("truth"))
    question = rewards.app_question(c["completed"], contained, number, value, truth.try_cast("bigint"), F.col("data") > 0, c["called"], F.col("successes") > 0)
    question = rewards.app_factors(question, c["invalid_ratio"], c["password"] | (F.col("responses") == 0), c["placeholder"], c["schema_args"], c["form"], c["completed"])
    return told.select(key, F.when(F.col("truth") != "", F.least(question, F.lit(1.0))).otherwise(rewards.app_action(c)).alias("reward"))
