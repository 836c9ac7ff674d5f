"""World jobs: order lines as steps of a household episode, told in observations, then replayed and rewarded.

An order is an episode, its lines are turns. The texts are made from the columns, so the same facts can be counted in SQL
without reading any text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.text import contents_of, flat_lines, let, oxford, parse_action, resolve_instance, room_blocks, rooms_of, thing_exists, verb_slots
from trailmill.jobs.common import table
from trailmill.operators import replay, rewards, tasks, trajectory

#: The six kinds of household task.
TASKS = ["pick_and_place_simple", "pick_two_obj_and_place", "pick_clean_then_place_in_recep", "pick_heat_then_place_in_recep", "pick_cool_then_place_in_recep", "look_at_obj_in_light"]


def _s(c):
    return c.cast("string")


def _messages(spark, sf_dir):
    """l_orderkey, turn, role, content: what happens depends on part and supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    mug, desk = F.concat(F.lit("mug "), _s(F.col("l_partkey") % 3 + 1)), F.concat(F.lit("desk "), _s(F.col("l_suppkey") % 2 + 1))
    kind = F.col("l_partkey") % 8
    said = (
        F.when(kind == 0, F.concat(F.lit("You pick up the "), mug, F.lit(" from the shelf 1.")))
        .when(kind == 1, F.concat(F.lit("You pick up the "), mug, F.lit(" from the "), desk, F.lit(".")))
        .when(kind == 2, F.concat(F.lit("You move the "), mug, F.lit(" to the "), desk, F.lit(".")))
        .when(kind == 3, F.concat(F.lit("You put the "), mug, F.lit(" in/on the "), desk, F.lit(".")))
        .when(kind == 4, F.concat(F.lit("You clean the "), mug, F.lit(" using the sinkbasin 1. You cool the "), mug, F.lit(" using the fridge 1.")))
        .when(kind == 5, F.concat(F.lit("You heat the "), mug, F.lit(" using the microwave 1.")))
        .when(kind == 6, F.lit("You turn on the desklamp 1."))
        .otherwise(F.concat(F.lit("You arrive at "), desk, F.lit(". On the "), desk, F.lit(", you see "), oxford(F.array(F.lit("pen 1"), mug)), F.lit(". Nothing happens.")))
    )
    return rows.select("l_orderkey", "turn", F.when(F.col("l_suppkey") % 10 == 9, "assistant").otherwise("user").alias("role"), said.alias("content"), "l_partkey", "l_suppkey")


def _tasks(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, TASKS)), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), kind.alias("task_type"), F.lit("mug").alias("target_obj"), F.lit("desk").alias("destination"), F.when(F.col("o_orderkey") % 6 == 5, "desklamp").otherwise("").alias("toggle_target"))


def world_events(spark, sf_dir):
    """How often each kind of event is told, in user turns only."""
    return replay.events(_messages(spark, sf_dir), "l_orderkey", "turn", "content").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_episodes"))


def world_goals(spark, sf_dir):
    return replay.goals(replay.events(_messages(spark, sf_dir), "l_orderkey", "turn", "content"), _tasks(spark, sf_dir), "l_orderkey", "turn")


def _prompts(spark, sf_dir):
    """l_orderkey, prompt: how things stand before the first turn, by the order's key."""
    key = F.col("o_orderkey")
    scene = F.concat(F.lit("## INITIAL SCENE\n- cabinet 1 ("), F.when(key % 2 == 0, "closed").otherwise("open"), F.lit(")\n  - shelf 1 (unknown)\n"), F.when(key % 3 == 0, "- desk 1 (closed)\n- desk (open)\n").otherwise(""))
    located = F.concat(F.lit("\n## INITIAL OBJECT LOCATIONS\n- plate 1: on shelf 1\n"), F.when(key % 5 == 0, "- mug 1: in cabinet 1\n").otherwise(""), F.lit("\n## RULES\n- pen 9: in desk 9\n"))
    return table(spark, sf_dir, "orders").select(key.alias("l_orderkey"), F.concat(F.lit("You are a world.\n"), scene, located).alias("prompt"))


def world_states(spark, sf_dir):
    """The state after each episode, from what the prompt tells and what happens: where, places, what is held, open and closed things, contents, flags, and what was seen."""
    told = replay.events(_messages(spark, sf_dir), "l_orderkey", "turn", "content")
    got = replay.final_state(told.unionByName(replay.initial(_prompts(spark, sf_dir), "l_orderkey", "prompt", "turn")), "l_orderkey", "turn")

    def told(sets: str, between: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.map_keys(sets)), lambda k: F.concat(k, F.lit("="), F.array_join(F.col(sets)[k], "+"))), between)

    lists = [F.array_join(F.array_sort(c) if c == "inventory" else F.col(c), ",").alias(name) for c, name in (("places", "places"), ("inventory", "held"), ("opened", "opened"), ("closed", "closed"), ("seen", "seen"))]
    return got.select("l_orderkey", F.coalesce("current_loc", F.lit("")).alias("current_loc"), *lists, told("flags", ",").alias("flags"), told("contents", ";").alias("contents"))


def world_rewards(spark, sf_dir):
    """The household reward of each episode: goal, part credit, loops and empty observations."""
    rows = _messages(spark, sf_dir).withColumn("action", F.substring_index("content", " the ", 1))
    q = trajectory.quality(rows, "l_orderkey", ["turn"], "action", F.contains("content", F.lit("Nothing happens.")))
    g = replay.goals(replay.events(rows, "l_orderkey", "turn", "content"), _tasks(spark, sf_dir), "l_orderkey", "turn")
    both = q.join(g, "l_orderkey")
    penalty = rewards.household_penalty(F.col("max_repeat"), F.col("max_nothing_streak"), F.col("n_nothing"), F.col("n_actions"))
    return both.select("l_orderkey", F.round(rewards.household(F.col("satisfied"), F.col("took"), F.col("placed"), F.col("transformed"), F.col("toggled"), F.col("n_actions"), penalty), 6).alias("reward"))


def world_actions(spark, sf_dir):
    """Actions as a model might write them, parsed to verb, object and place, with the instance meant."""
    name = F.concat(F.lit("mug "), _s(F.col("l_partkey") % 5))
    said = (
        F.when(F.col("l_partkey") % 8 == 4, F.concat(F.lit("<<wm>> <<b>> Action: take the "), name, F.lit(" from the desk 1.")))
        .when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("<think>hm</think>\nAction: Take the "), name, F.lit(" from a desk 1.")))
        .when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("Put "), name, F.lit(" in/on desk 2\nmore")))
        .when(F.col("l_partkey") % 4 == 2, F.lit("take mug"))
        .otherwise(F.lit("dance wildly now!"))
    )
    slots = verb_slots(parse_action(said))
    rows = table(spark, sf_dir, "lineitem").select(slots.alias("s"), resolve_instance(slots["object"], F.array(F.lit("pen 1"), F.lit("mug 3"), F.lit("mug 1"))).alias("meant"))
    return rows.groupBy(*(F.coalesce(F.col(f"s.{c}"), F.lit("none")).alias(c) for c in ("verb", "object", "place")), F.coalesce("meant", F.lit("none")).alias("meant")).agg(F.count("*").alias("n"))


def world_app_rewards(spark, sf_dir):
    """App rewards of each customer: orders as calls; a mix of what was called, failed and finished."""
    o = table(spark, sf_dir, "orders").withColumn("text", F.when(F.col("o_orderstatus") == "P", F.lit('{"error": 1}')).when(F.col("o_orderstatus") == "F", F.lit('{"id": 1}')).otherwise(F.lit("ok")))
    kind = trajectory.response_class(F.col("text"))
    n = o.groupBy("o_custkey").agg(
        F.count("*").alias("calls"), F.count_if(kind.isin("success", "data")).alias("successes"), F.count_if(kind == "data").alias("data"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("repeated"), F.max(F.col("o_orderkey") % 3 == 0).alias("password"), F.max(F.col("o_orderkey") % 50 == 1).alias("placeholder"),
    )
    key = F.col("o_custkey")
    c = {k: F.col(k) for k in ("calls", "repeated", "successes", "data", "password", "placeholder")}
    c |= {"responses": F.col("calls"), "credentials": key % 2 == 0, "schema_args": key % 11 == 0, "invalid_ratio": (key % 4) / 4.0, "completed": key % 3 != 0, "final_call": key % 5 != 0, "preamble": key % 100, "acted": key % 7 < 4, "mismatch": key % 13 == 0, "form": F.when(key % 17 == 0, 0.7).otherwise(1.0)}
    question = rewards.app_question(c["completed"], key % 9 == 0, key % 2 == 1, F.col("calls"), F.lit(10), F.col("data") > 0, F.col("calls") > 0)
    question = rewards.app_factors(question, c["invalid_ratio"], c["password"], c["placeholder"], c["schema_args"], c["form"], c["completed"])
    return n.select("o_custkey", F.round(rewards.app_action(c), 6).alias("action_reward"), F.round(question, 6).alias("question_reward"))


def room_maps(spark, sf_dir):
    """Room maps made of parts, a prompt for each brand, parsed back to rooms and their contents; of two blocks of a room the last counts."""
    block = F.concat(F.lit("[Room "), _s(F.col("p_size")), F.lit("]\n  "), F.col("p_name"), F.lit("\n\tthe agent\n"), F.col("p_type"), F.lit(" "))
    own = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("blocks"))
    prompt = F.concat(F.lit("Task: look\n\n## ROOMS\n\n"), F.col("blocks"), F.lit("\n\n## RULES\n[none]"))
    # A brand's blocks are read out of its prompt once, and only what is asked of them goes to the rows of its rooms.
    def told(blocks: Column) -> Column:
        return F.transform(F.filter(rooms_of(blocks), lambda r: r["key"] != "none"), lambda r: F.struct(r["key"].alias("room"), flat_lines(r["value"]).alias("contents"), (F.length(contents_of(blocks, F.initcap(r["key"]))) > 0).alias("found")))

    return own.select("p_brand", F.inline(let(room_blocks(prompt), told)))


def _moves(spark, sf_dir):
    t = F.col("turn")
    said = (
        F.when(t % 5 == 0, F.concat(F.lit("You move to the hall "), _s(t), F.lit(". Fine.")))
        .when(t % 5 == 1, F.concat(F.lit("This outside location is called the Yard "), _s(t), F.lit(".")))
        .when(t % 5 == 2, F.concat(F.lit("You are in: a place. It is called the den "), _s(t), F.lit(".")))
        .when(t % 5 == 3, F.lit("It is called the nothing."))
        .otherwise(F.lit("You look."))
    )
    return table(spark, sf_dir, "conversations").where(F.col("conv_id") % 4 > 0).select("conv_id", "turn", "role", said.alias("said"))


def room_latest(spark, sf_dir):
    """The room of each conversation's latest user turn that names one, and the first that is named."""
    m = _moves(spark, sf_dir)
    last, first = tasks.current_room(m, "conv_id", "turn", "role", "said"), tasks.first_room(m, "conv_id", "turn", "role", "said")
    return last.join(first.withColumnRenamed("room", "began"), "conv_id")


def world_things(spark, sf_dir):
    """Whether a thing is told of in the text of an order's world or is held."""
    p = _prompts(spark, sf_dir)
    held = F.when(F.col("l_orderkey") % 7 == 0, F.array(F.lit("Lamp 3"))).otherwise(F.array().cast("array<string>"))
    return p.select("l_orderkey", *(thing_exists(F.col("prompt"), held, F.lit(t)).alias(t.split()[0].lower()) for t in ("Mug 1", "LAMP 3", "desk 1", "sofa 1")))


QUERIES = {f.__name__: f for f in (room_maps, room_latest, world_things, world_events, world_goals, world_states, world_rewards, world_actions, world_app_rewards)}

STEPS = """
l AS (SELECT l_orderkey, l_partkey % 8 AS kind, 'mug ' || (l_partkey % 3 + 1) AS mug, 'desk ' || (l_suppkey % 2 + 1) AS desk, l_suppkey % 10 <> 9 AS heard,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS turn FROM lineitem),
h AS (SELECT * FROM l WHERE heard)"""
GOALS = f"""{STEPS},
x AS (SELECT *, sum(CASE WHEN kind IN (2, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, mug ORDER BY turn) AS puts FROM h),
lit AS (SELECT DISTINCT a.l_orderkey FROM h a JOIN x t ON t.l_orderkey = a.l_orderkey AND a.kind = 6 AND t.kind <= 1 AND t.turn < a.turn
  WHERE NOT EXISTS (SELECT 1 FROM h p WHERE p.l_orderkey = a.l_orderkey AND p.mug = t.mug AND p.kind IN (2, 3) AND p.turn > t.turn AND p.turn < a.turn)),
g AS (SELECT o_orderkey AS l_orderkey, o_orderkey % 6 AS task, count(DISTINCT CASE WHEN kind IN (2, 3) THEN mug END) AS n_put,
  coalesce(bool_or(kind <= 1), false) AS took, coalesce(bool_or(kind IN (2, 3)), false) AS placed, coalesce(bool_or(kind = 4), false) AS k4, coalesce(bool_or(kind = 5), false) AS k5, coalesce(bool_or(kind = 6), false) AS k6
  FROM orders LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY o_orderkey),
c AS (SELECT p.l_orderkey, bool_or(q.kind = 4) AS cleaned, bool_or(q.kind = 5) AS heated FROM h p JOIN h q ON p.l_orderkey = q.l_orderkey AND p.mug = q.mug WHERE p.kind IN (2, 3) GROUP BY p.l_orderkey),
r AS (SELECT g.l_orderkey, CASE task WHEN 0 THEN n_put > 0 WHEN 1 THEN n_put >= 2 WHEN 2 THEN coalesce(cleaned, false) WHEN 3 THEN coalesce(heated, false) WHEN 4 THEN coalesce(cleaned, false) ELSE lit.l_orderkey IS NOT NULL END AS satisfied,
  took, placed, (task IN (2, 4) AND k4) OR (task = 3 AND k5) AS transformed, task = 5 AND k6 AS toggled FROM g LEFT JOIN c ON c.l_orderkey = g.l_orderkey LEFT JOIN lit ON lit.l_orderkey = g.l_orderkey)"""

ORACLE_SQL = {
    "room_maps": """
WITH r AS (SELECT p_brand, p_size, arg_max(p_name || ' ' || p_type, p_partkey) AS c FROM part GROUP BY ALL) SELECT p_brand, 'room ' || p_size AS room, lower(c) AS contents, true AS found FROM r""",
    "room_latest": """
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE turn % 5 WHEN 0 THEN 'hall ' || turn WHEN 1 THEN 'Yard ' || turn WHEN 2 THEN 'den ' || turn END END AS room,
  CASE WHEN role = 'user' THEN CASE turn % 5 WHEN 1 THEN 'yard ' || turn WHEN 2 THEN 'den ' || turn WHEN 3 THEN 'nothing' END END AS named FROM conversations WHERE conv_id % 4 > 0)
SELECT conv_id, coalesce(arg_max(room, turn) FILTER (room IS NOT NULL), 'unknown') AS room, coalesce(arg_min(named, turn) FILTER (named IS NOT NULL), 'hallway') AS began FROM m GROUP BY conv_id""",
    "world_things": "SELECT o_orderkey AS l_orderkey, o_orderkey % 5 = 0 AS mug, o_orderkey % 7 = 0 AS lamp, o_orderkey % 3 = 0 AS desk, false AS sofa FROM orders",
    "world_events": f"""WITH {STEPS}, e AS (
  SELECT l_orderkey, CASE WHEN kind <= 1 THEN 'take' WHEN kind <= 3 THEN 'put' WHEN kind = 4 THEN 'clean' WHEN kind = 5 THEN 'heat' WHEN kind = 6 THEN 'use' ELSE 'go_open' END AS kind FROM h
  UNION ALL SELECT l_orderkey, 'cool' FROM h WHERE kind = 4)
SELECT kind, count(*) AS n, count(DISTINCT l_orderkey) AS n_episodes FROM e GROUP BY kind""",
    "world_goals": f"WITH {GOALS} SELECT l_orderkey, satisfied, took, placed, transformed, toggled FROM r",
    "world_states": f"""WITH {STEPS},
m AS (SELECT l_orderkey, mug, arg_max(kind, turn) FILTER (kind <= 3) AS last, bool_or(kind = 4) AS k4, bool_or(kind = 5) AS k5 FROM h GROUP BY l_orderkey, mug),
f AS (SELECT l_orderkey, string_agg(mug, ',' ORDER BY mug) FILTER (last <= 1) AS held, string_agg(mug || '=' || concat_ws('+', CASE WHEN k4 THEN 'clean+cool' END, CASE WHEN k5 THEN 'hot' END), ',' ORDER BY mug) FILTER (k4 OR k5) AS flags FROM m GROUP BY l_orderkey),
s AS (SELECT o_orderkey AS l_orderkey, o_orderkey % 2 = 0 AS shut, o_orderkey % 3 = 0 AS desk, o_orderkey % 5 = 0 AS mug FROM orders),
w AS (SELECT l_orderkey, arg_max(desk, turn) FILTER (kind = 7) AS loc, bool_or(kind = 6) AS lamp, coalesce(bool_or(kind = 7 AND desk = 'desk 1'), false) AS came1, coalesce(bool_or(kind = 7 AND desk = 'desk 2'), false) AS came2 FROM h GROUP BY l_orderkey),
y AS (SELECT l_orderkey, string_agg(DISTINCT thing, ',' ORDER BY thing) AS seen FROM (SELECT l_orderkey, mug AS thing FROM h WHERE kind IN (0, 1, 2, 3, 7) UNION ALL SELECT l_orderkey, 'pen 1' FROM h WHERE kind = 7 UNION ALL SELECT l_orderkey, 'plate 1' FROM s UNION ALL SELECT l_orderkey, 'mug 1' FROM s WHERE mug) GROUP BY l_orderkey),
adds AS (SELECT l_orderkey, desk, mug AS thing, turn * 2 + 1 AS at FROM h WHERE kind IN (2, 3, 7) UNION ALL SELECT l_orderkey, desk, 'pen 1', turn * 2 FROM h WHERE kind = 7 UNION ALL SELECT l_orderkey, 'shelf 1', 'plate 1', -2 FROM s UNION ALL SELECT l_orderkey, 'cabinet 1', 'mug 1', -1 FROM s WHERE mug),
gone AS (SELECT l_orderkey, CASE kind WHEN 1 THEN desk ELSE 'shelf 1' END AS desk, mug AS thing, max(turn * 2 + 1) AS until FROM h WHERE kind <= 1 GROUP BY ALL),
inside AS (SELECT a.l_orderkey, a.desk, a.thing, min(a.at) FILTER (g.until IS NULL OR a.at > g.until) AS since FROM adds a LEFT JOIN gone g ON g.l_orderkey = a.l_orderkey AND g.desk = a.desk AND g.thing = a.thing GROUP BY ALL),
place AS (SELECT l_orderkey, desk, coalesce(string_agg(thing, '+' ORDER BY since) FILTER (since IS NOT NULL), '') AS things FROM inside GROUP BY ALL),
con AS (SELECT l_orderkey, string_agg(desk || '=' || things, ';' ORDER BY desk) AS contents FROM place GROUP BY l_orderkey)
SELECT s.l_orderkey, coalesce(loc, '') AS current_loc, 'cabinet 1' || CASE WHEN s.desk THEN ',desk 1' ELSE '' END || ',shelf 1' AS places, coalesce(held, '') AS held,
  concat_ws(',', CASE WHEN NOT shut THEN 'cabinet 1' END, CASE WHEN came1 THEN 'desk 1' END, CASE WHEN came2 THEN 'desk 2' END) AS opened, concat_ws(',', CASE WHEN shut THEN 'cabinet 1' END, CASE WHEN s.desk AND NOT coalesce(came1, false) THEN 'desk 1' END) AS closed,
  seen, concat_ws(',', CASE WHEN lamp THEN 'desklamp 1=on' END, flags) AS flags, contents
FROM s JOIN y ON y.l_orderkey = s.l_orderkey JOIN con ON con.l_orderkey = s.l_orderkey LEFT JOIN f ON f.l_orderkey = s.l_orderkey LEFT JOIN w ON w.l_orderkey = s.l_orderkey""",
    "world_rewards": f"""WITH {GOALS},
a AS (SELECT l_orderkey, turn, kind = 7 AS nothing, CASE WHEN kind <= 1 THEN 'p' WHEN kind = 2 THEN 'm' WHEN kind = 3 THEN 'u' WHEN kind = 4 THEN 'c' WHEN kind = 5 THEN 'h' WHEN kind = 6 THEN 't' ELSE 'a' || desk END AS act FROM l),
i AS (SELECT *, turn - row_number() OVER (PARTITION BY l_orderkey, act ORDER BY turn) AS g, turn - row_number() OVER (PARTITION BY l_orderkey, nothing ORDER BY turn) AS ng FROM a),
q AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (nothing) AS nn FROM a GROUP BY l_orderkey),
q2 AS (SELECT l_orderkey, max(c) AS rep FROM (SELECT l_orderkey, act, g, count(*) AS c FROM i GROUP BY ALL) GROUP BY l_orderkey),
q3 AS (SELECT l_orderkey, max(c) AS streak FROM (SELECT l_orderkey, ng, count(*) AS c FROM i WHERE nothing GROUP BY ALL) GROUP BY l_orderkey),
z AS (SELECT r.*, n, CASE WHEN rep >= 3 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN coalesce(streak, 0) >= 4 THEN 0.6::DOUBLE ELSE 1 END * greatest(0.5::DOUBLE, 1 - nn::DOUBLE / n) AS penalty
  FROM r JOIN q ON q.l_orderkey = r.l_orderkey JOIN q2 ON q2.l_orderkey = r.l_orderkey LEFT JOIN q3 ON q3.l_orderkey = r.l_orderkey),
p AS (SELECT *, CASE WHEN placed THEN CASE WHEN transformed THEN 0.35 ELSE 0.25 END WHEN toggled AND took THEN 0.25 WHEN took THEN 0.03 WHEN n >= 10 THEN -0.05 ELSE 0 END AS part FROM z)
SELECT l_orderkey, round(CASE WHEN satisfied THEN least(1, penalty) ELSE least(part * penalty, 0.9) END, 6) AS reward FROM p""",
    "world_actions": """
WITH a AS (SELECT l_partkey % 4 AS k, 'mug ' || (l_partkey % 5) AS mug FROM lineitem),
s AS (SELECT CASE k WHEN 0 THEN 'take' WHEN 1 THEN 'put' WHEN 2 THEN 'take' ELSE 'none' END AS verb, CASE WHEN k <= 1 THEN mug WHEN k = 2 THEN 'mug' ELSE 'none' END AS object, CASE k WHEN 0 THEN 'desk 1' WHEN 1 THEN 'desk 2' ELSE 'none' END AS place,
  CASE WHEN k = 3 THEN 'none' WHEN k <= 1 AND mug IN ('mug 1', 'mug 3') THEN mug ELSE 'mug 3' END AS meant FROM a)
SELECT verb, object, place, meant, count(*) AS n FROM s GROUP BY ALL""",
    "world_app_rewards": """
WITH n AS (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) AS calls, count(*) FILTER (o_orderstatus <> 'P') AS ok, count(*) FILTER (o_orderstatus = 'F') AS data, count(*) FILTER (o_orderpriority = '1-URGENT') AS rep,
  bool_or(o_orderkey % 3 = 0) AS pw, bool_or(o_orderkey % 50 = 1) AS ph FROM orders GROUP BY o_custkey),
a AS (SELECT *, k % 3 <> 0 AS done, greatest(0.1::DOUBLE, 1 - (k % 4) / 4.0::DOUBLE) AS valid, CASE WHEN k % 17 = 0 THEN 0.7::DOUBLE ELSE 1 END AS form, CASE WHEN ph THEN 0.2::DOUBLE ELSE 1 END AS fp, CASE WHEN k % 11 = 0 THEN 0.3::DOUBLE ELSE 1 END AS fs,
  CASE WHEN NOT pw THEN 0.1::DOUBLE ELSE 1 END AS fw FROM n),
b AS (SELECT *, (0.6::DOUBLE * ok / calls + CASE WHEN data > 0 THEN 0.1::DOUBLE ELSE 0 END) * CASE WHEN calls > 2 AND rep / calls > 0.5 THEN 0.5::DOUBLE ELSE 1 END * fw + CASE WHEN k % 2 = 0 THEN 0.2::DOUBLE ELSE 0 END AS r0 FROM a),
c AS (SELECT *, r0 * fp * fs * valid * CASE WHEN done THEN 1 WHEN k % 5 = 0 THEN 0.3::DOUBLE WHEN k % 100 > 50 THEN 0.5::DOUBLE ELSE 1 END AS r1 FROM b),
d AS (SELECT *, CASE WHEN done THEN r1 + CASE WHEN k % 7 < 4 AND ok > 0 THEN 0.3::DOUBLE WHEN ok > 0 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END ELSE r1 * CASE WHEN k % 7 < 4 AND calls >= 8 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END END AS r2,
  CASE WHEN NOT done THEN CASE WHEN data > 0 THEN 0.15::DOUBLE WHEN calls > 0 THEN 0.03::DOUBLE ELSE 0 END WHEN k % 9 = 0 THEN 1
    WHEN k % 2 = 1 THEN greatest((1 - least(abs(calls - 10) / 10, 1)) * 0.25::DOUBLE, CASE WHEN data > 0 THEN 0.15::DOUBLE ELSE 0 END) WHEN data > 0 THEN 0.15::DOUBLE ELSE 0.08::DOUBLE END AS q FROM c)
SELECT k AS o_custkey, round(least(r2 * CASE WHEN k % 13 = 0 THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN done THEN form ELSE 1 END, 1), 6) AS action_reward,
  round(q * valid * fw * fp * fs * CASE WHEN done THEN form ELSE 1 END, 6) AS question_reward FROM d""",
}
