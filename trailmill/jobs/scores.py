"""Scoring jobs: documents as references, changed documents as predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.functions import jsonx
from trailmill.functions.text import goal, task_type
from trailmill.jobs.common import table
from trailmill.operators import rollups, scoring


def _predictions(spark, sf_dir):
    """Every fifth prediction is changed, some fail, some references are blank, some rows come twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit("!"))).when(F.col("doc_id") % 7 == 0, F.lit("ERROR: time-out")).otherwise(F.concat(F.lit("<tool_response> "), F.col("text"), F.lit(" </tool_response>")))
    rows = docs.select(F.col("doc_id").alias("index"), "lang", said.alias("prediction"), F.when(F.col("doc_id") % 11 == 0, F.lit("   ")).otherwise(F.col("text")).alias("reference"), F.lit(0).alias("copy"))
    return rows.unionByName(rows.where("index % 3 = 0").withColumn("prediction", F.lit("late copy")).withColumn("copy", F.lit(1)))


def score_summary(spark, sf_dir):
    kept = scoring.keep_first(_predictions(spark, sf_dir), ["index"], [F.col("copy")])
    got = scoring.summary(scoring.score(kept), "lang")
    return got.select("lang", "num_samples", F.round("exact_match", 9).alias("exact_match"), F.round("semantic_match", 9).alias("semantic_match"), "num_dropped_errors", "num_empty_ref_dropped")


def score_rows(spark, sf_dir):
    kept = scoring.keep_first(_predictions(spark, sf_dir), ["index"], [F.col("copy")])
    return scoring.score(kept).select("index", F.coalesce("reason", F.lit("scored")).alias("reason"), (F.col("reason").isNull() & F.col("exact")).alias("exact"))


def score_rouge_l(spark, sf_dir):
    """ROUGE-L of each whole document against the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pair = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return pair.select("doc_id", F.round(scoring.rouge_l(F.col("text"), F.col("other")), 6).alias("rouge_l"))


def score_summary_rouge(spark, sf_dir):
    """The summary with the mean of ROUGE-L and with overlong rows. Predictions hold two words more, or lack nothing, so what is shared is known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    said = F.when(F.col("doc_id") % 7 == 0, F.lit("ERROR: time-out")).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("qq1 "), F.col("text"), F.lit(" qq2"))).otherwise(F.col("text"))
    rows = docs.select("lang", said.alias("prediction"), F.col("text").alias("reference"), (F.col("doc_id") % 4 == 1).alias("overlong"), F.when(F.col("doc_id") % 13 != 1, True).alias("known"))
    scored = scoring.score(rows, "block", F.when(F.col("known"), F.col("overlong")))
    scored = scored.withColumn("rouge", F.when(F.col("reason").isNull(), scoring.rouge_l(F.col("prediction"), F.col("reference"))))
    got = scoring.summary(scored, "lang", "rouge")
    return got.select("lang", "num_samples", F.round("exact_match", 9).alias("exact_match"), F.round("rouge_l_f1", 9).alias("rouge_l_f1"), "num_skipped_overlong", "num_dropped_errors", "num_empty_ref_dropped")


def json_calls_in_prose(spark, sf_dir):
    """Calls inside of sentences in four notations, as an agent's and as a demonstration's text is read: which of two arguments counts differs."""
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 6
    name = F.concat(F.lit("log_"), F.col("event_type"))
    both = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": {"k": '), k, F.lit('}, "parameters": {"p": 1}}'))
    deep = F.concat(F.lit('[{"name": "'), name, F.lit('", "parameters": {"k": '), k, F.lit(', "in": {"a": [1, "]"]}}}]'))
    said = (
        F.when(n == 0, F.concat(F.lit("Sure [1]: <|tool_call_start|>["), name, F.lit("(k="), k, F.lit(', s="a b")]<|tool_call_end|> done')))
        .when(n == 1, F.concat(F.lit("So I call <tool_call> "), both, F.lit(" </tool_call> now")))
        .when(n == 2, F.concat(F.lit("As in [2, 3] {sic}: "), deep, F.lit(" and that is it.")))
        .when(n == 3, F.concat(F.lit('I {do} "this" '), both, F.lit(" }")))
        .when(n == 4, F.lit('no {call} here [1] {"x": 1}'))
        .otherwise(both)
    )
    rows = table(spark, sf_dir, "events").select("event_id", jsonx.tool_call(said).alias("c"), jsonx.demo_call(said).alias("d"))
    return rows.select("event_id", "c.name", "c.arguments", F.col("d.name").alias("demo_name"), F.col("d.arguments").alias("demo_arguments"))


def json_canonical(spark, sf_dir):
    """Event arguments as JSON objects in other orders and forms, made canonical in both styles, and compared."""
    k = F.get_json_object("props", "$.k")
    shuffled = F.concat(F.lit('{"z": 1.0, "k": '), k, F.lit(', "a": "é", "k": '), k, F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit(" bad "), k)).otherwise(shuffled).alias("j"), k.alias("k"))
    both = F.concat(F.lit('{"k":'), F.col("k"), F.lit('.0,"z":1,"a":"é"}'))
    return rows.select("event_id", jsonx.canonical(F.col("j")).alias("compact"), jsonx.canonical(F.col("j"), spaced=True).alias("spaced"), jsonx.semantic_equal("j", both).alias("same"))


def json_tool_calls(spark, sf_dir):
    """Tool calls in three notations, parsed back to a name and arguments."""
    k = F.get_json_object("props", "$.k")
    name = F.concat(F.lit("log_"), F.col("event_type"))
    body = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": {"k": '), k, F.lit("}}"))
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), name, F.lit("(k="), k, F.lit(")]"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("<tool_call>"), body, F.lit("</tool_call>"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.lit("no call"))
    return table(spark, sf_dir, "events").select("event_id", jsonx.tool_call(said).alias("c")).select("event_id", "c.name", "c.arguments")


def json_output_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"rest": 1, "output": "'), F.col("event_type"), F.lit('"}'))).otherwise(F.col("event_type")).alias("j"))
    return rows.select("event_id", jsonx.output_fields("j").alias("kept"))


def doc_length_stats(spark, sf_dir):
    return rollups.lengths(table(spark, sf_dir, "documents"), F.col("text"), ["lang"])


def doc_task_types(spark, sf_dir):
    """Ids like lang_source_v12, grouped by what stands before the version."""
    task = F.concat_ws("_", "lang", "source", F.concat(F.lit("v"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").groupBy(task_type(task).alias("task_type")).agg(F.count("*").alias("n"))


def doc_goals(spark, sf_dir):
    said = F.concat(F.lit("You are here. Your task is to: none\nYour task is to: "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(goal(said)).alias("goal_md5"))


def label_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rollups.win_rate(rows, F.col("quality") == 1, ["lang"]).withColumn("win_rate", F.round("win_rate", 9))


QUERIES = {f.__name__: f for f in (score_summary, score_summary_rouge, score_rows, score_rouge_l, json_canonical, json_tool_calls, json_calls_in_prose, json_output_fields, doc_length_stats, doc_task_types, doc_goals, label_rates)}

PREDICTIONS = """
p AS (SELECT doc_id AS index, lang, text AS t, doc_id % 5 = 0 AS changed, doc_id % 5 <> 0 AND doc_id % 7 = 0 AS failed, doc_id % 11 = 0 AS blank FROM documents),
s AS (SELECT *, CASE WHEN failed THEN 'error' WHEN blank OR trim(t, ' ' || chr(10)) = '' THEN 'empty_reference' END AS reason, NOT changed AND NOT failed AS exact FROM p)"""

ORACLE_SQL = {
    "score_summary": f"""WITH {PREDICTIONS}
SELECT lang, count(*) FILTER (reason IS NULL) AS num_samples, round(count(*) FILTER (reason IS NULL AND exact) / greatest(count(*) FILTER (reason IS NULL), 1), 9) AS exact_match,
  round(count(*) FILTER (reason IS NULL AND exact) / greatest(count(*) FILTER (reason IS NULL), 1), 9) AS semantic_match, count(*) FILTER (reason = 'error') AS num_dropped_errors, count(*) FILTER (reason = 'empty_reference') AS num_empty_ref_dropped
FROM s GROUP BY lang""",
    "score_summary_rouge": r"""
WITH d AS (SELECT lang, doc_id, len(list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS n FROM documents),
r AS (SELECT lang, CASE WHEN doc_id % 4 = 1 AND doc_id % 13 <> 1 THEN 'overlong' WHEN doc_id % 7 = 0 THEN 'error' WHEN n = 0 THEN 'empty' END AS reason, doc_id % 3 <> 0 AS exact, CASE WHEN doc_id % 3 = 0 THEN 2.0::DOUBLE * n / (2 * n + 2) ELSE 1 END AS f FROM d)
SELECT lang, count(*) FILTER (reason IS NULL) AS num_samples, round(count(*) FILTER (reason IS NULL AND exact) / greatest(count(*) FILTER (reason IS NULL), 1), 9) AS exact_match,
  round(coalesce(sum(f) FILTER (reason IS NULL), 0) / greatest(count(*) FILTER (reason IS NULL), 1), 9) AS rouge_l_f1,
  count(*) FILTER (reason = 'overlong') AS num_skipped_overlong, count(*) FILTER (reason = 'error') AS num_dropped_errors, count(*) FILTER (reason = 'empty') AS num_empty_ref_dropped FROM r GROUP BY lang""",
    "json_calls_in_prose": """
WITH e AS (SELECT event_id, event_id % 6 AS n, 'log_' || event_type AS name, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN n <> 4 THEN name END AS name, CASE n WHEN 0 THEN '{"k": ' || k || ', "s": "a b"}' WHEN 2 THEN '{"in": {"a": [1, "]"]}, "k": ' || k || '}' WHEN 4 THEN NULL ELSE '{"k": ' || k || '}' END AS arguments,
  CASE WHEN n NOT IN (0, 4) THEN name END AS demo_name, CASE WHEN n IN (1, 3) THEN '{"k": ' || k || '}' WHEN n = 5 THEN '{"p": 1}' ELSE '{}' END AS demo_arguments FROM e""",
    "score_rows": f"WITH {PREDICTIONS} SELECT index, coalesce(reason, 'scored') AS reason, reason IS NULL AND exact AS exact FROM s",
    "json_canonical": """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'bad ' || k ELSE '{"a":"é","k":' || k || ',"z":1.0}' END AS compact, CASE WHEN event_id % 9 = 0 THEN 'bad ' || k ELSE '{"a": "é", "k": ' || k || ', "z": 1.0}' END AS spaced, event_id % 9 <> 0 AS same FROM e""",
    "json_tool_calls": """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 'log_' || event_type END AS name, CASE WHEN event_id % 4 < 3 THEN '{"k": ' || json_extract_string(props, '$.k') || '}' END AS arguments FROM events""",
    "json_output_fields": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"output":"' || event_type || '"}' ELSE event_type END AS kept FROM events""",
    "doc_length_stats": "SELECT lang, min(length(text)) AS shortest, max(length(text)) AS longest, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS mean_floor FROM documents GROUP BY lang",
    "doc_task_types": "SELECT lang || '_' || source AS task_type, count(*) AS n FROM documents GROUP BY 1",
    "doc_goals": r"SELECT doc_id, md5(left(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '^\s+', ''), '\s+$', ''), 120)) AS goal_md5 FROM documents",
    "label_rates": "SELECT lang, count(*) FILTER (quality = 1) AS n_won, count(*) AS n, round(count(*) FILTER (quality = 1) / count(*), 9) AS win_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang",
}
