"""Trajectory jobs on the event table: a user is a trajectory, (ts, event_id) its order, an error an empty observation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.functions.text import safe_int
from trailmill.jobs.common import table
from trailmill.operators import rewards, rollups, trajectory

KEY, ORDER = "user_id", ["ts", "event_id"]


def _flags(spark, sf_dir):
    return trajectory.loop_flags(table(spark, sf_dir, "events").select(KEY, *ORDER, "event_type", "value"), KEY, ORDER, "event_type", F.col("event_type") == "error")


def traj_loop_flags(spark, sf_dir):
    return _flags(spark, sf_dir).select(KEY, "event_id", F.col("n").cast("long").alias("n"), "aaa", "abab", "streak", F.coalesce(F.col("recent").cast("long"), F.lit(-1)).alias("recent"))


def traj_quality(spark, sf_dir):
    return trajectory.quality(table(spark, sf_dir, "events").select(KEY, *ORDER, "event_type"), KEY, ORDER, "event_type", F.col("event_type") == "error")


def traj_runs(spark, sf_dir):
    r = trajectory.runs(table(spark, sf_dir, "events").select(KEY, *ORDER, "event_type"), KEY, ORDER, "event_type")
    return r.groupBy("event_type", "length").agg(F.count("*").alias("n"))


def traj_kills(spark, sf_dir):
    """Where each episode ends under each rule, and why."""
    flags = _flags(spark, sf_dir)
    got = None
    for rule in ("rollout", "eval", "fast", "science"):
        own = flags.withColumn("kill", trajectory.kill_reason(flags, rule)).where("kill IS NOT NULL").groupBy(KEY).agg(F.min("n").cast("long").alias("turns"), F.min_by("kill", "n").alias("kill")).withColumn("rule", F.lit(rule))
        got = own if got is None else got.unionByName(own)
    return got


def traj_truncate(spark, sf_dir):
    flags = _flags(spark, sf_dir)
    cut = trajectory.truncate(flags.withColumn("kill", trajectory.kill_reason(flags, "eval")), KEY, "n", F.col("kill").isNotNull())
    return cut.groupBy(KEY).agg(F.count("*").alias("n_turns"), F.count("kill").alias("n_kills"))


def traj_repeated_calls(spark, sf_dir):
    """Two calls in a row with the same type and arguments."""
    rows = table(spark, sf_dir, "events").withColumn("signature", F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")))
    return trajectory.repeated_call(rows, KEY, ORDER, "signature").groupBy(KEY).agg(F.count_if("repeated").alias("n_repeated"), F.count("*").alias("n"))


def traj_running_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(KEY, *ORDER, "event_type")
    return rows.select(KEY, "event_id", F.round(trajectory.running_mean(rows, KEY, ORDER, (F.col("event_type") == "purchase").cast("double")), 9).alias("running"))


def traj_kill_histogram(spark, sf_dir):
    kills = traj_kills(spark, sf_dir)
    own = table(spark, sf_dir, "events").select(KEY).distinct().join(kills.where("rule = 'fast'"), KEY, "left")
    return rollups.top_reasons(own, F.col("kill"))


def traj_win_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(KEY).agg(F.max_by("event_type", F.struct(*ORDER)).alias("last"), F.min_by("event_type", F.struct(*ORDER)).alias("task_type"))
    return rollups.win_rate(rows, F.col("last") == "purchase", ["task_type"]).withColumn("win_rate", F.round("win_rate", 9))


def traj_scores(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy(KEY).agg(F.round(F.max("value")).alias("score"), F.count("*").alias("n_steps"), F.min_by("event_type", F.struct(*ORDER)).alias("task_type"))
    got = rollups.scores(own, F.col("score"), F.col("n_steps"), ["task_type"])
    return got.select("task_type", "n", *(F.round(c, 6).alias(c) for c in ("mean_score", "full_rate", "partial_rate", "mean_steps")))


def traj_science_reward(spark, sf_dir):
    """The science reward by user and day: score from the mean value, a click counts as a focus."""
    rows = table(spark, sf_dir, "events").withColumn("rid", F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    q = trajectory.quality(rows.select("rid", *ORDER, "event_type"), "rid", ORDER, "event_type", F.col("event_type") == "error")
    s = rows.groupBy("rid").agg((F.round(F.avg("value")) - 50).alias("score"), F.max(F.col("event_type") == "click").alias("has_focus"))
    both = q.join(s, "rid")
    return both.select("rid", F.round(rewards.science(F.col("score"), F.col("n_actions"), F.col("has_focus"), F.col("n_aaa") + F.col("n_abab")), 9).alias("reward"))


def traj_args(spark, sf_dir):
    """Arguments from JSON: safe integers, clamped."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy(F.least(F.greatest(safe_int(k, 5), F.lit(1)), F.lit(20)).alias("page_limit")).agg(F.count("*").alias("n"), F.count_if(safe_int(k).isNull()).alias("n_bad"))


def traj_nearest_number(spark, sf_dir):
    """Documents as answers: the number nearest to a truth, and its credit."""
    truth = F.pmod(F.col("doc_id"), F.lit(97))
    rows = table(spark, sf_dir, "documents").select("doc_id", truth.alias("truth"), rewards.nearest_number(F.col("text"), truth).alias("nearest"))
    return rows.where("nearest IS NOT NULL").select("doc_id", "nearest", F.round(rewards.number_credit(F.col("nearest"), F.col("truth")), 9).alias("credit"))


QUERIES = {f.__name__: f for f in (traj_loop_flags, traj_quality, traj_runs, traj_kills, traj_truncate, traj_repeated_calls, traj_running_mean, traj_kill_histogram, traj_win_rate, traj_scores, traj_science_reward, traj_args, traj_nearest_number)}


def flags_sql(key: str = "user_id", rows: str = "events") -> str:
    return f"""
a AS (SELECT *, {key} AS k, row_number() OVER w AS n, lag(event_type, 1) OVER w AS a1, lag(event_type, 2) OVER w AS a2, lag(event_type, 3) OVER w AS a3,
  sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS g,
  count(DISTINCT event_type) OVER (PARTITION BY {key} ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS d
  FROM {rows} WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
f AS (SELECT *, coalesce(event_type = a1 AND event_type = a2, false) AS aaa, coalesce(event_type = a2 AND a1 = a3 AND event_type <> a1, false) AS abab,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY k, g ORDER BY ts, event_id) AS BIGINT) AS streak, CASE WHEN n >= 20 THEN d END AS recent FROM a)"""


KILLS = {
    "rollout": "CASE WHEN aaa OR abab OR coalesce(recent <= 3, false) THEN 'loop' WHEN streak >= 4 THEN 'stuck' END",
    "eval": "CASE WHEN aaa THEN 'loop' WHEN streak >= 4 THEN 'stuck' END",
    "fast": "CASE WHEN aaa THEN 'loop' WHEN abab THEN 'loop_abab' WHEN streak >= 4 THEN 'stuck' END",
    "science": "CASE WHEN aaa OR abab OR coalesce(recent < 5, false) THEN 'loop' END",
}
KILLS_SQL = f"WITH {flags_sql()}, kills AS (" + " UNION ALL ".join(f"SELECT user_id, min(n) AS turns, min_by({k}, n) AS kill, '{r}' AS rule FROM f WHERE {k} IS NOT NULL GROUP BY user_id" for r, k in KILLS.items()) + ")"

ORACLE_SQL = {
    "traj_loop_flags": f"WITH {flags_sql()} SELECT user_id, event_id, n, aaa, abab, streak, coalesce(recent, -1) AS recent FROM f",
    "traj_quality": f"""WITH {flags_sql()},
i AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, max(c) AS m FROM (SELECT user_id, event_type, g, count(*) AS c FROM i GROUP BY ALL) GROUP BY user_id)
SELECT user_id, count(*) AS n_actions, count(*) FILTER (event_type = 'error') AS n_nothing, max(m) AS max_repeat, max(streak) AS max_nothing_streak, count(*) FILTER (aaa) AS n_aaa, count(*) FILTER (abab) AS n_abab
FROM f JOIN r USING (user_id) GROUP BY user_id""",
    "traj_runs": """
WITH i AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT event_type, count(*) AS length FROM i GROUP BY user_id, event_type, g) SELECT event_type, length, count(*) AS n FROM r GROUP BY event_type, length""",
    "traj_kills": f"{KILLS_SQL} SELECT user_id, turns, kill, rule FROM kills",
    "traj_truncate": f"""WITH {flags_sql()}, e AS (SELECT *, {KILLS["eval"]} AS kill FROM f), t AS (SELECT *, min(CASE WHEN kill IS NOT NULL THEN n END) OVER (PARTITION BY user_id) AS last FROM e)
SELECT user_id, count(*) AS n_turns, count(kill) AS n_kills FROM t WHERE last IS NULL OR n <= last GROUP BY user_id""",
    "traj_repeated_calls": """
WITH s AS (SELECT user_id, ts, event_id, concat_ws('|', event_type, json_extract_string(props, '$.k')) AS g FROM events),
r AS (SELECT user_id, coalesce(g = lag(g) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS r FROM s) SELECT user_id, count(*) FILTER (r) AS n_repeated, count(*) AS n FROM r GROUP BY user_id""",
    "traj_running_mean": "SELECT user_id, event_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running FROM events",
    "traj_kill_histogram": f"{KILLS_SQL} SELECT coalesce(kill, 'completed') AS reason, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM kills WHERE rule = 'fast') USING (user_id) GROUP BY 1 ORDER BY n DESC, reason LIMIT 5",
    "traj_win_rate": """
WITH u AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last, min_by(event_type, (ts, event_id)) AS task_type FROM events GROUP BY user_id)
SELECT task_type, count(*) FILTER (last = 'purchase') AS n_won, count(*) AS n, round(count(*) FILTER (last = 'purchase') / count(*), 9) AS win_rate FROM u GROUP BY task_type""",
    "traj_scores": """
WITH u AS (SELECT user_id, round(max(value)) AS score, count(*) AS n_steps, min_by(event_type, (ts, event_id)) AS task_type FROM events GROUP BY user_id)
SELECT task_type, count(*) AS n, round(sum(score) / count(*), 6) AS mean_score, round(count(*) FILTER (score >= 100) / count(*), 6) AS full_rate, round(count(*) FILTER (score >= 50) / count(*), 6) AS partial_rate, round(sum(n_steps) / count(*), 6) AS mean_steps FROM u GROUP BY task_type""",
    "traj_science_reward": f"""
WITH e AS (SELECT *, user_id || ':' || strftime(ts, '%Y-%m-%d') AS rid FROM events), {flags_sql("rid", "e")},
q AS (SELECT k AS rid, count(*) AS n, round(avg(value)) - 50 AS score, bool_or(event_type = 'click') AS focus, count(*) FILTER (aaa) + count(*) FILTER (abab) AS reps FROM f GROUP BY k),
r1 AS (SELECT *, CASE WHEN score < 0 THEN CASE WHEN score <= -50 THEN -0.2 ELSE greatest(score / 100.0, -0.1) END ELSE score / 100.0 END AS r FROM q),
r2 AS (SELECT *, CASE WHEN NOT focus AND n >= 10 THEN least(r, -0.15) ELSE r END AS s FROM r1),
r3 AS (SELECT *, CASE WHEN n <= 2 AND s < 0 THEN least(s * 1.5, -0.1) ELSE s END AS t FROM r2)
SELECT rid, round(CAST(greatest(least(CASE WHEN reps > 0 THEN t * greatest(0.3, 1.0 - 0.15 * reps) ELSE t END, 1.0), -0.2) AS DOUBLE), 9) AS reward FROM r3""",
    "traj_args": "SELECT least(greatest(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 5), 1), 20) AS page_limit, count(*) AS n, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS n_bad FROM events GROUP BY 1",
    "traj_nearest_number": r"""
WITH d AS (SELECT doc_id, doc_id % 97 AS truth, unnest(regexp_extract_all(text, '\d+')) AS s, generate_subscripts(regexp_extract_all(text, '\d+'), 1) AS i FROM documents),
n AS (SELECT doc_id, truth, TRY_CAST(s AS BIGINT) AS v, i FROM d WHERE TRY_CAST(s AS BIGINT) IS NOT NULL),
b AS (SELECT doc_id, truth, v, row_number() OVER (PARTITION BY doc_id ORDER BY abs(v - truth), i) AS k FROM n)
SELECT doc_id, v AS nearest, round(CAST((1.0 - least(abs(v - truth) / greatest(truth, 1), 1.0)) * 0.25 AS DOUBLE), 9) AS credit FROM b WHERE k = 1""",
}
