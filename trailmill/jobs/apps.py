"""App jobs: customers and orders as prompts with credentials and as calls, judged from their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmill.functions import jsonx
from trailmill.jobs.common import table
from trailmill.operators import apps, rollouts

#: The tools that an order's call may name, by order key; the last two are in no catalogue.
TOOLS = ["spotify__show_album", "venmo__show_transactions", "spotify__login", "venmo__login", "phone__login", "simple_note__show_note", "file_system__show_directory", "spotify__fly", "none"]


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _calls(spark, sf_dir):
    """o_orderkey, prompt, said: each order's customer gives the prompt, the order's key what is called and how."""
    key = F.col("o_orderkey")
    user = F.concat(F.lit("user"), _s("o_custkey"), F.lit("@mail.org"))
    line = lambda app, word: F.concat(F.lit(f"- {app}: username="), user, F.lit(", password="), word, F.lit("\n"))
    word = F.concat(F.lit("pw-"), _s(F.col("o_custkey") % 97))
    prompt = F.concat(F.lit("## CREDENTIALS\n"), line("spotify", F.lit("old")), line("venmo", word), line("spotify", F.concat(word, F.lit("!"))), F.lit("\n  albums (2 total)\n    - album_id: "), _s(key % 5), F.lit(", title: x\n"))
    tool = F.get(F.array(*map(F.lit, TOOLS)), (key % 9).cast("int"))
    given = F.when(tool == "spotify__login", F.when(key % 4 == 0, F.lit("old")).otherwise(F.concat(word, F.lit("!")))).otherwise(F.when(key % 4 == 0, F.lit("wrong")).otherwise(word))
    value = F.when(key % 10 == 3, F.lit('{"type": "string", "default": null}')).when(key % 10 == 4, F.lit("\"{'type': 'integer'}\"")).when(key % 10 == 5, F.lit('{"kind": 1}')).otherwise(_s(key % 3))
    place = F.when(key % 2 == 0, F.concat(F.lit('"album_id": '), _s(key % 3), F.lit(', "page_limit": '), value)).otherwise(F.concat(F.lit('"page_limit": '), value, F.lit(', "album_id": '), _s(key % 3)))
    args = F.when(F.endswith(tool, F.lit("__login")), F.concat(F.lit('{"username": "'), user, F.lit('", "password": "'), given, F.lit('"}'))).otherwise(F.concat(F.lit("{"), place, F.lit("}")))
    body = F.concat(F.lit('{"name": "'), tool, F.lit('", "arguments": '), args, F.lit("}"))
    said = F.when(key % 3 == 0, F.concat(F.lit("I see [1] and {that}. "), body, F.lit(" Fine."))).when(key % 3 == 1, F.concat(F.lit("<tool_call>"), body, F.lit("</tool_call>"))).otherwise(F.concat(F.lit("So:\n["), body, F.lit("]")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", prompt.alias("prompt"), said.alias("said"))


def _parsed(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("call", jsonx.tool_call("said"))
    return calls.select("o_orderkey", "o_custkey", "prompt", F.col("call.name").alias("tool"), F.col("call.arguments").alias("arguments"))


def _catalogue(spark):
    return spark.createDataFrame([(t,) for t in [*apps.SECTION_OF_TOOL, "spotify__login", "venmo__login", "phone__login"]], "tool string")


def app_logins(spark, sf_dir):
    """Logins in the calls, right, wrong and of apps that the prompt doesn't name; of an app that it names twice the last line counts."""
    calls = _parsed(spark, sf_dir).where(F.endswith("tool", F.lit(apps.LOGIN)))
    known = apps.credentials(F.col("prompt"))
    accepted = apps.login_accepted(F.col("tool"), F.col("arguments"), known)
    return calls.select("o_orderkey", apps.app_of(F.col("tool")).alias("app"), apps.api_of(F.col("tool")).alias("api"), accepted.alias("accepted"), F.size(known).cast("long").alias("n_known"), F.size(apps.credentials_listed(F.col("prompt"))).cast("long").alias("n_listed"))


def app_call_errors(spark, sf_dir):
    """The first thing wrong with each call: tool, schema in place of a value, credentials, record."""
    album = apps.argument(F.col("arguments"), "album_id")
    found = F.contains("prompt", F.concat(F.lit("- album_id: "), album, F.lit(",")))
    calls = apps.with_error(_parsed(spark, sf_dir), _catalogue(spark), found=found)
    return calls.select("o_orderkey", F.coalesce("error", F.lit("")).alias("error"))


def app_return_keys(spark, sf_dir):
    """The section and the key of the answer for each call; tools without a section answer under ``data``."""
    calls = apps.with_return_key(_parsed(spark, sf_dir))
    return calls.groupBy("tool", F.coalesce("section", F.lit("")).alias("section"), "return_key").agg(F.count("*").alias("n"))


def app_placeholders(spark, sf_dir):
    """Events' arguments with a piece of schema at any key, as an object, or inside of a text; and the first list that is not empty."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    key = F.concat(F.lit("a"), F.col("k"))
    value = F.when(F.col("event_id") % 4 == 0, F.lit('{"type": "string"}')).when(F.col("event_id") % 4 == 1, F.lit('"x {\\"type\\": 1}"')).when(F.col("event_id") % 4 == 2, F.lit('{"kind": {"type": 1}}')).otherwise(F.lit('"type"'))
    items = F.when(F.col("event_id") % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), F.col("k"), F.lit(', "'), F.col("event_type"), F.lit('"]')))
    said = F.concat(F.lit('{"total": 2, "z'), key, F.lit('": '), value, F.lit(', "items": '), items, F.lit(', "b": null, "also": [[1]]}'))
    listed = jsonx.first_list(said)
    return e.select("event_id", jsonx.has_placeholder_argument(said).alias("placeholder"), listed["key"].alias("key"), F.size(listed["items"]).cast("long").alias("n_items"))


def app_signatures(spark, sf_dir):
    """Tools made of brands, with their kinds of part as parameters, as text; and a brand that takes none."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tool"), F.when(F.col("p_brand") != "Brand#11", F.col("p_type")).alias("parameter")).distinct()
    return apps.signatures(p.withColumn("place", F.col("parameter")))


#: A customer's orders, oldest first, as the calls of a rollout, by order key; the name after the comma is in no catalogue.
STEPS = ["supervisor__show_account_passwords", "spotify__login", "spotify__show_album", "spotify__like_song", "bogus__tool", "spotify__show_album"]


def _rollouts(spark, sf_dir):
    """Messages (two for each order), and the end of each customer's rollout."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind, word = k % 6, F.concat(F.lit("pw-"), _s(c), F.lit("-x"))
    args = (
        F.when(kind == 1, F.concat(F.lit('{"username": "u", "password": "'), F.when(k % 4 != 0, word).otherwise(F.lit("your_password")), F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"album_id": '), _s(k % 3), F.lit("}")))
        .when(kind == 3, F.lit('{"song_id": 5}'))
        .when(kind == 5, F.lit('{"album_id": {"type": "integer"}}'))
        .otherwise(F.lit("{}"))
    )
    call = F.concat(F.lit('[{"name": "'), F.get(F.array(*map(F.lit, STEPS)), kind.cast("int")), F.lit('", "parameters": '), args, F.lit("}]"))
    reply = (
        F.when(kind == 0, F.concat(F.lit('[{"app": "spotify", "username": "u", "password": "'), word, F.lit('", "note": "of this customer only"}]')))
        .when(kind == 1, F.lit('{"access_token": "t"}'))
        .when(kind == 2, F.when(F.col("o_orderstatus") == "P", '{"error": 1}').otherwise('{"id": 1}'))
        .when(kind == 3, F.lit("ok"))
        .when(kind == 4, F.lit('{"ERROR": "no such tool"}'))
        .otherwise(F.lit(""))
    )
    two = F.array(F.struct((2 * k).alias("turn"), F.lit("assistant").alias("role"), call.alias("content")), F.struct((2 * k + 1).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("<tool_response>\n"), reply, F.lit("\n</tool_response>")).alias("content")))
    messages = table(spark, sf_dir, "orders").select("o_custkey", F.explode(two).alias("m")).select("o_custkey", "m.*")
    n = F.col("c_custkey") % 5
    done = lambda name, answer: F.lit(f'{{"name": "supervisor__complete_task", "{name}": {{"answer": "{answer}"}}}}')
    completion = (
        F.when(n == 0, F.lit("I give up"))
        .when(n == 1, F.concat(F.lit("<think>so</think>["), done("parameters", "42 or 12"), F.lit("]")))
        .when(n == 2, F.concat(F.repeat(F.lit("well "), F.lit(12)), F.lit('{"name": "spotify__show_album", "arguments": {}}')))
        .when(n == 3, F.concat(F.lit("<tool_call>"), done("arguments", "about 9"), F.lit("</tool_call>")))
        .otherwise(done("parameters", "it is gold"))
    )
    truth = F.when(F.col("c_custkey") % 3 == 1, "10").when(F.col("c_custkey") % 3 == 2, "Gold")
    instruction = F.when(F.col("c_custkey") % 7 == 0, "Please Unfollow them").when(F.col("c_custkey") % 7 == 1, "delete it").otherwise("play")
    return messages, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), completion.alias("completion"), instruction.alias("instruction"), truth.alias("truth"))


def app_rollout_rewards(spark, sf_dir):
    """The reward of each customer's rollout, all of it read from texts: calls, responses, credentials, the last answer."""
    messages, ends = _rollouts(spark, sf_dir)
    known = spark.createDataFrame([(t,) for t in {*STEPS, "supervisor__complete_task"} - {"bogus__tool"}], "tool string")
    told = rollouts.facts(messages, ends, known, "o_custkey", "turn", "role", "content")
    return rollouts.app_rewards(told, "o_custkey").select("o_custkey", F.round("reward", 9).alias("reward"))


QUERIES = {f.__name__: f for f in (app_rollout_rewards, app_logins, app_call_errors, app_return_keys, app_placeholders, app_signatures)}

CALLS = """
c AS (SELECT o_orderkey AS k, o_custkey, ['spotify__show_album', 'venmo__show_transactions', 'spotify__login', 'venmo__login', 'phone__login', 'simple_note__show_note', 'file_system__show_directory', 'spotify__fly', 'none'][o_orderkey % 9 + 1] AS tool FROM orders)"""

ORACLE_SQL = {
    "app_rollout_rewards": """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 6 AS kind, o_orderstatus AS st, CASE o_orderkey % 6 WHEN 1 THEN 'l' || (o_orderkey % 4 <> 0) WHEN 2 THEN 'a' || o_orderkey % 3 ELSE 'k' || o_orderkey % 6 END AS sig FROM orders),
p AS (SELECT c, min(k) FILTER (kind = 0) AS first FROM o GROUP BY c),
a AS (SELECT o.c, count(*) AS n, count(*) FILTER (kind IN (0, 1, 3) OR kind = 2 AND st <> 'P') AS ok, count(*) FILTER (kind = 0 OR kind = 2 AND st <> 'P') AS data, count(*) - count(DISTINCT sig) AS rep,
  bool_or(kind = 1 AND k % 4 <> 0 AND coalesce(k > first, false)) AS real, bool_or(kind = 1 AND k % 4 = 0 OR kind = 5) AS made, bool_or(kind = 5) AS typed, count(*) FILTER (kind = 4) AS wrong, bool_or(kind = 0) AS pw, bool_or(kind IN (3, 4)) AS acted, bool_or(kind = 3) AS liked
  FROM o JOIN p ON p.c = o.c GROUP BY o.c),
r AS (SELECT c_custkey AS c, c_custkey % 5 AS e, c_custkey % 3 AS q, c_custkey % 7 AS i, CAST(coalesce(n, 0) AS DOUBLE) AS n, coalesce(ok, 0) AS ok, coalesce(data, 0) AS data, coalesce(rep, 0) AS rep, coalesce(real, false) AS real, coalesce(made, false) AS made, coalesce(typed, false) AS typed,
  coalesce(wrong, 0) AS wrong, coalesce(pw, false) AS pw, coalesce(acted, false) AS acted, coalesce(liked, false) AS liked FROM customer LEFT JOIN a ON a.c = c_custkey),
s AS (SELECT *, e IN (1, 3, 4) AS done, e <> 0 AS final, n + CASE WHEN e <> 0 THEN 1 ELSE 0 END AS names, CASE e WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0.7::DOUBLE * 0.4::DOUBLE WHEN 3 THEN 0.4::DOUBLE * 0.7::DOUBLE * 0.4::DOUBLE ELSE 1 END AS form FROM r),
f AS (SELECT *, greatest(0.1::DOUBLE, 1 - wrong / greatest(names, 1)) AS valid, CASE WHEN NOT pw AND n > 0 THEN 0.1::DOUBLE ELSE 1 END AS fw, CASE WHEN made THEN 0.2::DOUBLE ELSE 1 END AS fp, CASE WHEN typed THEN 0.3::DOUBLE ELSE 1 END AS ft FROM s),
qs AS (SELECT *, CASE WHEN NOT done THEN CASE WHEN data > 0 THEN 0.15::DOUBLE WHEN n > 0 OR final THEN 0.03::DOUBLE ELSE 0 END
    WHEN q = 2 AND e = 4 THEN 1
    WHEN q = 1 THEN greatest(CASE e WHEN 1 THEN 0.2::DOUBLE WHEN 3 THEN 0.225::DOUBLE ELSE 0 END, CASE WHEN data > 0 THEN 0.15::DOUBLE ELSE 0 END)
    ELSE CASE WHEN data > 0 THEN 0.15::DOUBLE WHEN ok > 0 THEN 0.08::DOUBLE ELSE 0.03::DOUBLE END END * valid * fw * fp * ft * CASE WHEN done THEN form ELSE 1 END AS question,
  CASE WHEN n > 0 THEN 0.6::DOUBLE * ok / n + CASE WHEN data > 0 THEN 0.1::DOUBLE ELSE 0 END ELSE 0.05::DOUBLE END * CASE WHEN n > 2 AND rep / n > 0.5 THEN 0.5::DOUBLE ELSE 1 END * fw + CASE WHEN real THEN 0.2::DOUBLE ELSE 0 END AS r0 FROM f),
r1 AS (SELECT *, r0 * fp * ft * valid * CASE WHEN done OR n = 0 THEN 1 WHEN NOT final THEN 0.3::DOUBLE WHEN e = 2 THEN 0.5::DOUBLE ELSE 1 END AS r1 FROM qs),
r2 AS (SELECT *, CASE WHEN done THEN r1 + CASE WHEN acted AND ok > 0 THEN 0.3::DOUBLE WHEN ok > 0 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END ELSE r1 * CASE WHEN acted AND names >= 8 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END END * CASE WHEN i <= 1 AND liked THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN done THEN form ELSE 1 END AS act FROM r1)
SELECT c AS o_custkey, round(CASE WHEN q > 0 THEN least(question, 1) WHEN n = 0 AND NOT final THEN 0 ELSE least(act, 1) END, 9) AS reward FROM r2""",
    "app_logins": f"""WITH {CALLS}
SELECT k AS o_orderkey, string_split(tool, '__')[1] AS app, 'login' AS api, tool = 'phone__login' OR k % 4 <> 0 AS accepted, CAST(2 AS BIGINT) AS n_known, CAST(3 AS BIGINT) AS n_listed FROM c WHERE tool LIKE '%__login'""",
    "app_call_errors": f"""WITH {CALLS}
SELECT k AS o_orderkey, CASE WHEN tool IN ('spotify__fly', 'none') THEN 'Unknown tool: ' || tool WHEN k % 10 IN (3, 4) AND NOT tool LIKE '%login' THEN 'Invalid argument values: schema/type dictionaries are not runtime values'
  WHEN tool IN ('spotify__login', 'venmo__login') AND k % 4 = 0 THEN 'Invalid username or password' WHEN tool IN ('spotify__show_album', 'simple_note__show_note') AND k % 3 <> k % 5 THEN 'Record not found' ELSE '' END AS error FROM c""",
    "app_return_keys": f"""WITH {CALLS}, s AS (SELECT tool, CASE tool WHEN 'spotify__show_album' THEN 'albums' WHEN 'venmo__show_transactions' THEN 'transactions' WHEN 'simple_note__show_note' THEN 'notes' WHEN 'file_system__show_directory' THEN 'directories' ELSE '' END AS section FROM c)
SELECT tool, section, CASE section WHEN '' THEN 'data' WHEN 'directories' THEN 'entries' ELSE section END AS return_key, count(*) AS n FROM s GROUP BY ALL""",
    "app_placeholders": """
SELECT event_id, event_id % 4 <= 1 AS placeholder, CASE WHEN event_id % 3 = 0 THEN 'also' ELSE 'items' END AS key, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_items FROM events""",
    "app_signatures": """
SELECT p_brand AS tool, p_brand || '(' || CASE WHEN p_brand = 'Brand#11' THEN 'no parameters' ELSE string_agg(DISTINCT p_type, ', ' ORDER BY p_type) END || ')' AS signature FROM part GROUP BY p_brand""",
}
