"""Chat jobs: build, check, split, merge, migrate; each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.functions.text import demo_action, header, observation, parse_action, science_action, strip_tags
from trailmill.jobs.common import table
from trailmill.operators import chat, rewards, trajectory
from trailmill.shared import new_path
from trailmill.sources import chat_jsonl

#: Old and new names for the migration job, as they occur in the texts of the tables.
NAMES = [("the ", "THE_"), ("der ", "DER_"), ("que ", "QUE_")]


def chat_prompt_reference(spark, sf_dir):
    chats = chat.prompt_and_reference(chat.gather(table(spark, sf_dir, "conversations")))
    return chats.select("conv_id", F.size("prompt").cast("long").alias("n_prompt"), F.md5(F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("prompt_md5"), F.md5("reference").alias("reference_md5"))


def chat_merge_system(spark, sf_dir):
    chats = chat.gather(table(spark, sf_dir, "conversations")).withColumn("merged", chat.merge_system(F.col("messages")))
    return chats.select("conv_id", F.size("merged").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("merged", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("merged_md5"))


def chat_jsonl_counters(spark, sf_dir):
    """Chats as JSON lines of four shapes (wrapped, bare, without content, no JSON), read leniently and counted."""
    chats = chat.gather(table(spark, sf_dir, "conversations"))
    line = F.when(F.col("conv_id") % 4 == 0, F.to_json(F.struct("messages"))).when(F.col("conv_id") % 4 == 1, F.to_json("messages")).when(F.col("conv_id") % 4 == 2, F.lit('{"messages":[{"role":"user"}]}')).otherwise(F.concat(F.lit("not json "), F.col("conv_id").cast("string")))
    both = chats.select(line.alias("line"))
    wrapped = chat_jsonl.counters(both.select(chat_jsonl.chat_of(F.col("line")).alias("messages"))).withColumn("mode", F.lit("default"))
    return wrapped.unionByName(chat_jsonl.counters(both.select(chat_jsonl.chat_of(F.col("line"), passthrough=True).alias("messages"))).withColumn("mode", F.lit("passthrough")))


def chat_string_decode(spark, sf_dir):
    """Messages stored as a JSON text of a JSON text, decoded like plain ones."""
    chats = chat.gather(table(spark, sf_dir, "conversations"))
    inner = F.to_json("messages")
    as_text = F.regexp_replace(F.regexp_replace(inner, r"\\", r"\\\\"), '"', r'\\"')
    stored = F.when(F.col("conv_id") % 2 == 0, inner).otherwise(F.concat(F.lit('"'), as_text, F.lit('"')))
    return chats.withColumn("decoded", chat_jsonl.decode_either(stored)).select("conv_id", F.size("decoded").cast("long").alias("n"), F.md5(F.array_join(F.transform("decoded", lambda m: m["content"]), "\n")).alias("content_md5"))


def chat_user_turns(spark, sf_dir):
    """User turns with the commands that follow from the chat's roles so far."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.md5(chat.with_observation(F.col("text"), F.array(F.lit("look"), F.concat(F.lit("go to room "), F.col("turn").cast("string"))))).alias("turn_md5"))


def chat_preceding_assistant(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    near = rows.withColumn("before", trajectory.preceding(rows, "conv_id", ["turn"], F.col("role") == "assistant", F.col("text")))
    return near.where("role = 'user'").select("conv_id", "turn", F.md5(F.coalesce("before", F.lit("none"))).alias("before_md5"))


def chat_first_seen(spark, sf_dir):
    rows = trajectory.first_seen(table(spark, sf_dir, "conversations"), "role", ["conv_id", "turn"], F.col("text"), 12)
    return rows.groupBy("role").agg(F.count_if("first").alias("n_unique"), F.count_if(~F.col("first")).alias("n_repeated"))


def chat_last_answer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.md5(F.max_by("text", "turn")).alias("answer_md5"))


def chat_migrate(spark, sf_dir):
    chats = chat.gather(table(spark, sf_dir, "conversations")).withColumn("messages", chat.migrate(F.col("messages"), NAMES))
    return chats.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\n")).alias("content_md5"))


def chat_residual_names(spark, sf_dir):
    chats = chat.gather(table(spark, sf_dir, "conversations")).withColumn("messages", chat.migrate(F.col("messages"), NAMES))
    return chat.residual_names(chats, NAMES)


def chat_response_classes(spark, sf_dir):
    kind = trajectory.response_class(F.when(F.col("turn") % 5 == 3, F.lit('{"error": "x"}')).when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").groupBy(kind.alias("response")).agg(F.count("*").alias("n"))


def text_strip_tags(spark, sf_dir):
    """Documents wrapped in tags, stripped by each profile."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>plan</think> "), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("pre<tool_response>\n "), F.col("text"), F.lit(" \n</tool_response>post"))).otherwise(F.concat(F.lit("</think> "), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", *(F.md5(strip_tags(raw, p)).alias(f"{p}_md5") for p in ("block", "windowed", "ar")))


def _wrapped(spark, sf_dir, cases: list):
    """conv_id, turn, raw: each whole text in the wrapper of its turn."""
    raw = F.get(F.array(*cases), F.col("turn").cast("int") % len(cases))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))


def clean_observations(spark, sf_dir):
    """Whole texts as world models wrap their observations: tags, back-ticks, lists, contents that are lists of parts."""
    said = F.coalesce("text", F.lit(""))
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))))
    cases = [F.concat(F.lit("<think>[hm]</think><tool_response> "), said, F.lit("</tool_response>")), F.concat(F.lit("```\n"), said, F.lit("```")), F.to_json(F.array(F.struct(said.alias("content")))), F.to_json(F.array(F.struct(parts.alias("content"))))]
    return _wrapped(spark, sf_dir, cases).select("conv_id", "turn", F.md5(observation(F.col("raw"))).alias("seen_md5"))


def clean_science_actions(spark, sf_dir):
    """The action in each whole text, wrapped as models of the science harness reply; narrations and long lines give ''."""
    cases = [F.concat(F.lit(head), F.coalesce("text", F.lit(""))) for head in ("<think>hm</think>[INST] Action: ", '```x```"', "<b>", "I need to ")]
    return _wrapped(spark, sf_dir, cases).select("conv_id", "turn", science_action(F.col("raw")).alias("action"))


def clean_demo_actions(spark, sf_dir):
    """The action in each whole text, wrapped as demonstration writers reply."""
    cases = [F.concat(F.lit(head), F.coalesce("text", F.lit(""))) for head in ("1. `", "- Action: ", "")]
    return _wrapped(spark, sf_dir, cases).select("conv_id", "turn", demo_action(F.col("raw")).alias("action"))


def chat_few_shot(spark, sf_dir):
    """Each chat's turns as examples between a system text and a question, and what of it a world model is sent."""
    chats = chat.gather(table(spark, sf_dir, "conversations"))
    built = chats.select("conv_id", chat.few_shot(F.lit("You are a world."), F.col("messages"), F.concat(F.lit("And chat "), F.col("conv_id").cast("string"), F.lit("?"))).alias("all"))
    said = lambda m: F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n"))
    sent = chat.for_model(F.col("all"))
    return built.select("conv_id", F.size("all").cast("long").alias("n_all"), F.size(sent).cast("long").alias("n_sent"), said(F.col("all")).alias("all_md5"), said(sent).alias("sent_md5"))


def chat_log(spark, sf_dir):
    """Turns appended to a log in two writes, each with its observation cut to a fixed length, and read back."""
    path = new_path(spark, "log")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rid"), "turn", F.col("role").alias("action"), F.col("text").alias("obs"), (F.col("turn") % 2 == 0).alias("won"), F.lit("test").alias("via"))
    for part in (0, 1):
        chat_jsonl.append_log(rows.where(F.pmod("rid", F.lit(2)) == part), path)
    back = spark.read.schema("rid bigint, turn bigint, action string, obs string, won boolean, via string").json(path)
    return back.select(F.col("rid").alias("conv_id"), "turn", F.length("obs").cast("long").alias("n_obs"), F.md5("obs").alias("obs_md5"), "won")


def chat_headers(spark, sf_dir):
    """Header lines of a prompt made of a document's facts: task, date (blank for some), and one that stands inside of a line."""
    prompt = F.concat(F.lit("Intro\nTask type: "), F.col("lang"), F.lit("-"), F.col("source"), F.lit("  \nCurrent date:"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" 2024-01-"), F.col("doc_id").cast("string"))).otherwise(""), F.lit("\nno Goal: x\n"))
    return table(spark, sf_dir, "documents").select("doc_id", *(F.coalesce(header(prompt, h), F.lit("none")).alias(n) for h, n in (("Task type", "task"), ("Current date", "date"), ("Goal", "goal"))))


def chat_form(spark, sf_dir):
    """The factor for how an assistant turn gives its action: none, after many characters, or well."""
    said = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.concat(F.repeat(F.lit("well "), (F.col("conv_id") % 12).cast("int")), F.lit("Action: look"))).otherwise(F.lit("Action: look"))
    action = F.when(said != "", parse_action(said))
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", rewards.household_form(action, F.substring_index(said, "Action:", 1)).alias("form"))


QUERIES = {f.__name__: f for f in (chat_few_shot, chat_log, chat_headers, chat_form, chat_prompt_reference, chat_merge_system, chat_jsonl_counters, chat_string_decode, chat_user_turns, chat_preceding_assistant, chat_first_seen, chat_last_answer, chat_migrate, chat_residual_names, chat_response_classes, text_strip_tags, clean_observations, clean_science_actions, clean_demo_actions)}

MOVED = "CASE WHEN role <> 'user' THEN replace(replace(replace(text, 'the ', 'THE_'), 'der ', 'DER_'), 'que ', 'QUE_') ELSE text END"
WRAPPED = "CASE doc_id % 3 WHEN 0 THEN '<think>plan</think> ' || text WHEN 1 THEN 'pre<tool_response>' || chr(10) || ' ' || text || ' ' || chr(10) || '</tool_response>post' ELSE '</think> ' || text END"
BARE = r"regexp_replace(x, '^(Action|Command|>)\s*:?\s*', '', 'i')"
TRIM = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
LINE = TRIM.format(f"split_part({TRIM.format("coalesce(text, '')")}, chr(10), 1)")

ORACLE_SQL = {
    "chat_few_shot": """
SELECT conv_id, count(*) + 2 AS n_all, count(*) FILTER (role IN ('user', 'assistant', 'tool')) + 1 AS n_sent, md5('system:You are a world.' || chr(10) || string_agg(role || ':' || text, chr(10) ORDER BY turn) || chr(10) || 'user:And chat ' || conv_id || '?') AS all_md5,
  md5(concat_ws(chr(10), string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (role IN ('user', 'assistant', 'tool')), 'user:And chat ' || conv_id || '?')) AS sent_md5 FROM conversations GROUP BY conv_id""",
    "chat_log": "SELECT conv_id, turn, length(left(text, 240)) AS n_obs, md5(left(text, 240)) AS obs_md5, turn % 2 = 0 AS won FROM conversations",
    "chat_headers": "SELECT doc_id, lang || '-' || source AS task, CASE WHEN doc_id % 3 > 0 THEN '2024-01-' || doc_id ELSE 'none' END AS date, 'none' AS goal FROM documents",
    "chat_form": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0.3::DOUBLE WHEN turn % 3 = 1 AND conv_id % 12 * 5 > 32 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS form FROM conversations WHERE role = 'assistant'",
    "chat_prompt_reference": """
WITH r AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, count(*) FILTER (turn < last) AS n_prompt, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (turn < last)) AS prompt_md5, md5(max(text) FILTER (turn = last)) AS reference_md5
FROM r WHERE n >= 2 GROUP BY conv_id""",
    "chat_merge_system": """
WITH s AS (SELECT conv_id, text AS sys FROM conversations c WHERE role = 'system' AND turn = (SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id)),
u AS (SELECT conv_id, min(turn) AS first_user FROM conversations WHERE role = 'user' GROUP BY conv_id),
m AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN s.sys IS NOT NULL AND c.turn = u.first_user THEN s.sys || chr(10) || chr(10) || c.text ELSE c.text END AS text,
  s.sys IS NOT NULL AND c.role = 'system' AND c.turn = min(c.turn) OVER (PARTITION BY c.conv_id) AS gone
  FROM conversations c LEFT JOIN s USING (conv_id) LEFT JOIN u USING (conv_id))
SELECT conv_id, count(*) FILTER (NOT gone) AS n_messages, md5(coalesce(string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (NOT gone), '')) AS merged_md5 FROM m GROUP BY conv_id""",
    "chat_jsonl_counters": """
WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'default' AS mode, count(*) AS n_in, count(*) FILTER (conv_id % 4 IN (0, 1)) AS n_out, count(*) FILTER (conv_id % 4 NOT IN (0, 1)) AS n_skipped FROM c
UNION ALL SELECT 'passthrough', count(*), count(*) FILTER (conv_id % 4 = 1), count(*) FILTER (conv_id % 4 <> 1) FROM c""",
    "chat_string_decode": "SELECT conv_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_md5 FROM conversations GROUP BY conv_id",
    "chat_user_turns": "SELECT conv_id, turn, md5('Observation:' || chr(10) || text || chr(10) || chr(10) || 'Admissible commands:' || chr(10) || '- look' || chr(10) || '- go to room ' || turn) AS turn_md5 FROM conversations WHERE role = 'user'",
    "chat_preceding_assistant": """
WITH p AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM conversations)
SELECT conv_id, turn, md5(coalesce(b, 'none')) AS before_md5 FROM p WHERE role = 'user'""",
    "chat_first_seen": """
WITH f AS (SELECT role, row_number() OVER (PARTITION BY role, left(text, 12) ORDER BY conv_id, turn) = 1 AS first FROM conversations)
SELECT role, count(*) FILTER (first) AS n_unique, count(*) FILTER (NOT first) AS n_repeated FROM f GROUP BY role""",
    "chat_last_answer": "SELECT conv_id, md5(max_by(text, turn)) AS answer_md5 FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "chat_migrate": f"SELECT conv_id, md5(string_agg({MOVED}, chr(10) ORDER BY turn)) AS content_md5 FROM conversations GROUP BY conv_id",
    "chat_residual_names": f"""
WITH m AS (SELECT {MOVED} AS text FROM conversations), n(old_name) AS (VALUES ('the '), ('der '), ('que '))
SELECT old_name, count(*) AS n FROM m, n WHERE contains(text, old_name) GROUP BY old_name""",
    "chat_response_classes": """
WITH t AS (SELECT CASE WHEN turn % 5 = 3 THEN '{"error": "x"}' WHEN turn % 5 = 4 THEN '  ' ELSE text END AS x FROM conversations),
k AS (SELECT CASE WHEN trim(x) = '' THEN 'empty' WHEN contains(lower(x), '"error"') OR contains(lower(x), 'execution failed') OR contains(lower(x), 'traceback') THEN 'error'
  WHEN length(x) > 50 OR contains(lower(x), '"id"') OR contains(lower(x), '"title"') THEN 'data' ELSE 'success' END AS response FROM t)
SELECT response, count(*) AS n FROM k GROUP BY response""",
    "clean_observations": f"WITH t AS (SELECT conv_id, turn, {TRIM.format("coalesce(text, '')")} AS x FROM conversations) SELECT conv_id, turn, md5(CASE WHEN x = '' THEN 'Nothing happens.' ELSE x END) AS seen_md5 FROM t",
    "clean_science_actions": f"""
WITH t AS (SELECT conv_id, turn, {LINE} AS x FROM conversations), a AS (SELECT *, CASE turn % 4 WHEN 0 THEN x WHEN 3 THEN '' ELSE {BARE} END AS y FROM t)
SELECT conv_id, turn, CASE WHEN length(y) > 200 OR regexp_matches(y, '^-?\\d+\\.?\\d*$') THEN ''
  WHEN regexp_matches(y, '^(success|fail|error|done|complete|score|i need|i should|i will|i''ll|let me|the task|this task|now i|step \\d|observation|reward|result|note:)', 'i') THEN '' ELSE y END AS action FROM a""",
    "clean_demo_actions": f"WITH t AS (SELECT conv_id, turn, {LINE} AS x FROM conversations) SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN x ELSE {BARE} END AS action FROM t",
    "text_strip_tags": f"""
WITH w AS (SELECT doc_id, {WRAPPED} AS x, text FROM documents)
SELECT doc_id, md5({TRIM.format("text")}) AS block_md5,
  md5({TRIM.format("CASE doc_id % 3 WHEN 0 THEN 'plan ' || text ELSE text END")}) AS windowed_md5,
  md5({TRIM.format("CASE doc_id % 3 WHEN 0 THEN 'plan ' || text WHEN 1 THEN 'pre' || chr(10) || ' ' || text || ' ' || chr(10) || 'post' ELSE text END")}) AS ar_md5 FROM w""",
}
