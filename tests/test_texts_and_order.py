"""Global order, calls inside of texts, app prompts, folders, sinks, first states, rooms and streams of several batches: hand-made cases."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from trailmill.functions import jsonx, text
from trailmill.jobs import folders as jobs
from trailmill.operators import apps, ordering, records, replay, sampling, tasks
from trailmill.shared import new_path
from trailmill.sources import folders, sinks
from trailmill.streaming import kills


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


# order


def test_numbers_over_a_table(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", "c"]), rng.choice([None, 1, 2, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v int").withColumn("_part", F.lit("clash")).withColumn("_at", F.lit(0)).repartition(7)
    key = lambda r: (r[2] is not None, r[2] or 0, -r[0])  # noqa: E731  nulls first
    whole = {r: n for n, r in enumerate(sorted(rows, key=key))}
    order = [F.col("v"), F.col("id").desc()]
    got = ordering.numbered(df, order, "n", partitions=5)
    assert got.columns == [*df.columns, "n"] and {(r["id"], r["g"], r["v"]): r["n"] for r in got.collect()} == whole
    within = {r: sum(key(o) < key(r) for o in rows if o[1] == r[1]) for r in rows}
    assert {(r["id"], r["g"], r["v"]): r["number"] for r in ordering.numbered_within(df, ["g"], order, partitions=6).collect()} == within
    some = ordering.rows_at(df, order, 390, 420)
    assert sorted(r["number"] for r in some.collect()) == list(range(390, 400))
    with pytest.raises(ValueError):
        ordering.numbered(df, order, "G")


def test_numbers_of_ties_and_nothing(spark):
    same = spark.createDataFrame([(1, "x")] * 60, "id long, g string")
    assert sorted(r["number"] for r in ordering.numbered(same, [F.col("id")], partitions=4).collect()) == list(range(60))
    assert sorted(r["number"] for r in ordering.numbered_within(same, ["g"], [F.col("id")], partitions=4).collect()) == list(range(60))
    assert ordering.numbered(same.limit(0), [F.col("id")]).count() == 0 and ordering.numbered_within(same.limit(0), ["g"], [F.col("id")]).count() == 0


def test_one_group_is_numbered_by_many_tasks(spark):
    """A group of all rows lies in several ranges, none with more than a part of it."""
    hot = spark.range(4000).select("id", F.lit("hot").alias("g"))
    placed, part, _ = ordering.ranges(hot, [F.col("g"), F.col("id")], 8)
    sizes = [r["count"] for r in placed.groupBy(part).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1200
    got = sampling.round_robin(hot.withColumn("shard", F.lit("clash")), "g", ["id"], 3)
    assert {(r["id"], r["shard"]) for r in got.collect()} == {(i, i % 3) for i in range(4000)}


def test_files_in_order(spark):
    rows = spark.createDataFrame([(i * 37 % 101, str(i)) for i in range(101)], "k long, s string")
    path = new_path(spark, "test-order")
    ordering.write_in_order(rows, [F.col("k")], path, 6)
    assert {(r["k"], r["number"]) for r in ordering.read_in_order(spark, path).collect()} == {(k, k) for k in range(101)}


def test_pages_of_any_depth(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.randrange(50)) for i in range(300)] + [(300, "c", 1)]
    df = spark.createDataFrame(rows, "id long, g string, v int").withColumn("total", F.lit("clash")).withColumn("pos", F.lit("clash")).withColumn("_piece", F.lit("clash"))
    by = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], -r[0])) for g in {r[1] for r in rows}}
    for index in (0, 2, 40):
        got = records.page(df, ["g"], [F.col("v"), F.desc("id")], index, 7).collect()
        want = set()
        for g, own in by.items():
            on = [(g, len(own), r[0], n) for n, r in enumerate(own, 1) if index * 7 < n <= index * 7 + 7]
            want |= set(on or [(g, len(own), None, None)])
        assert {(r["g"], r["total"], r["id"], r["pos"]) for r in got} == want
    deep, records.DEEP = records.DEEP, 20
    whole = sorted(rows, key=lambda r: (r[2], -r[0]))
    got = records.page(df, [], [F.col("v"), F.desc("id")], 30, 10).collect()
    none = records.page(df, [], [F.col("v")], 10**6, 10).collect()
    records.DEEP = deep
    assert {(r["total"], r["pos"], r["id"]) for r in got} == {(301, 301, whole[300][0])}
    assert [(r["total"], r["pos"], r["id"]) for r in none] == [(301, None, None)]


# calls inside of texts

CALLS = [
    ('<|tool_call_start|>[do_it(a="x y", n=3)]<|tool_call_end|>', "do_it", {"a": "x y", "n": 3}),
    ('text [sic] <tool_call> {"name": "f", "arguments": {"a": {"b": [1, "}"]}}} </tool_call>', "f", {"a": {"b": [1, "}"]}}),
    ('I think [1] so {it} goes: [{"name": "g", "parameters": {"q": "]["}}] end', "g", {"q": "]["}),
    ('say "hi" then {"name": "h", "arguments": "{\\"k\\": 1}"} bye }', "h", {"k": 1}),
    ('{"x": {"name": "inner"}} and {"name": "outer", "arguments": [1]}', "outer", {}),
    ('{"name": "obj"} [{"name": "arr", "arguments": {"a": 1}, "parameters": {"b": 2}}]', "arr", {"a": 1}),
    ('```json\n{"name": "fenced"}\n```', "fenced", {}),
    ('open { "name and [{"name": "late"}]', "late", {}),
    ("<tool_call>nothing</tool_call>", None, None),
    ('{"name": broken', None, None),
    ("", None, None),
    (None, None, None),
]


def test_calls_in_texts(spark):
    got = spark.createDataFrame([(c[0],) for c in CALLS], "t string").select(jsonx.tool_call("t").alias("c")).collect()
    assert [(r["c"]["name"], r["c"]["arguments"] and json.loads(r["c"]["arguments"])) for r in got] == [c[1:] for c in CALLS]
    demo = [('[{"name": "a", "arguments": {"x": 1}, "parameters": {"y": 2}}]', "a", {"y": 2}), ('so "name" : "b", "arguments": {"x": 1} fin', "b", {"x": 1}), ('"name": "c" "parameters": {"x": {"y": 1}}', "c", {}), ("none", None, {})]
    got = spark.createDataFrame([(d[0],) for d in demo], "t string").select(jsonx.demo_call("t").alias("c")).collect()
    assert [(r["c"]["name"], json.loads(r["c"]["arguments"])) for r in got] == [d[1:] for d in demo]


def test_brackets_take_one_pass():
    assert jsonx.balanced('a [1, {"b": "]"}] {"c": []}') == [(2, 17), (6, 16), (18, 27), (24, 26)]
    long = '{"a": ' * 50_000 + "x"
    assert jsonx.balanced(long) == []


def test_objects_of_unknown_keys(spark):
    cases = [
        ('{"a": 1, "b": {"type": null}}', True), ('{"a": "x {\'type\': 1}"}', True), ('{"a": "{ \\"type\\": 1}"}', False), ('{"a": "{\\"type\\": 1}"}', True),
        ('{"type": "string"}', False), ('{"a": {"b": {"type": 1}}, "c": [{"type": 1}]}', False), ("{}", False), ("no", False), ("[1]", False), (None, False),
    ]
    got = spark.createDataFrame([(c[0],) for c in cases], "t string").select(jsonx.has_placeholder_argument(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [c[1] for c in cases]
    lists = [('{"z": [], "b": 1, "y": [1, [2]], "a": [3]}', "y", 2), ('{"a": {"b": [1]}}', None, None), ("[1]", None, None), (None, None, None)]
    got = spark.createDataFrame([(c[0],) for c in lists], "t string").select(jsonx.first_list(F.col("t")).alias("x")).collect()
    assert [(r["x"] and r["x"]["key"], r["x"] and len(r["x"]["items"])) for r in got] == [c[1:] for c in lists]


def test_texts_that_are_no_json_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("plain \x1d", "plain"), (" x", "x"), ("{bad ", "{bad"), (' {"b":1,"a":2}', '{"a":2,"b":1}'), (None, None)], "t string, want string")
    assert all(r["c"] == r["want"] for r in df.select(jsonx.canonical(F.col("t")).alias("c"), "want").collect())


# app prompts

PROMPT = "x\n- spotify: username=a b@c, password=one\n- venmo: username=v, password=p,w\n- spotify: username=new, password=two\n- Büro: username=ü, password=ß"


def test_credentials(spark):
    got = one(spark, apps.credentials(F.col("p")), p=PROMPT)
    assert {k: (v["username"], v["password"]) for k, v in got.items()} == {"spotify": ("new", "two"), "venmo": ("v", "p,w"), "Büro": ("ü", "ß")}
    assert [c["app"] for c in one(spark, apps.credentials_listed(F.col("p")), p=PROMPT)] == ["spotify", "venmo", "spotify", "Büro"]
    assert one(spark, apps.credentials(F.col("p")), p=None) == {}
    ok = lambda tool, args: one(spark, apps.login_accepted(F.col("t"), F.col("a"), apps.credentials(F.col("p"))), t=tool, a=args, p=PROMPT)
    assert ok("spotify__login", '{"username": "new", "password": "two"}') and not ok("spotify__login", '{"username": "a b@c", "password": "one"}')
    assert not ok("venmo__login", "{}") and not ok("venmo__login", None) and ok("phone__login", "{}") and ok("venmo__show", "{}")


def test_dimension_by_both_joins(spark):
    calls = spark.createDataFrame([("spotify__show_album", 1), ("venmo__search_friends", 2), ("spotify__login", 3), ("nothing", 4), (None, 5), ("spotify__show_album", 6)], "tool string, i int").withColumn("_key", F.lit(0)).withColumn("section", F.lit("clash"))
    few, many = (sorted((r["i"], r["section"], r["return_key"]) for r in apps.with_return_key(calls, sent=n).collect()) for n in (10_000, 0))
    assert few == many == [(1, "albums", "albums"), (2, "venmo_friends", "friends"), (3, None, "data"), (4, None, "data"), (5, None, "data"), (6, "albums", "albums")]
    plans = [apps.with_return_key(calls, sent=n)._jdf.queryExecution().optimizedPlan().toString() for n in (10_000, 0)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]
    assert [one(spark, f(F.col("t")), t="a_b__c__d") for f in (apps.app_of, apps.api_of)] == ["a_b", "c__d"] and one(spark, apps.api_of(F.col("t")), t="plain") == "plain"


def test_first_thing_wrong_with_a_call(spark):
    rows = [("a", "fly", "{}"), ("b", "venmo__login", '{"username": {"type": "string"}}'), ("c", "venmo__login", '{"username": "v", "password": "no"}'), ("d", "spotify__show_album", '{"album_id": 3}'), ("e", "spotify__show_album", '{"album_id": 4}'), ("f", None, None)]
    calls = spark.createDataFrame(rows, "i string, tool string, arguments string").withColumn("prompt", F.lit(PROMPT)).withColumn("error", F.lit("clash"))
    tools = spark.createDataFrame([("venmo__login",), ("spotify__show_album",), ("spotify__show_album",), (None,)], "tool string")
    got = apps.with_error(calls, tools, found=apps.argument(F.col("arguments"), "album_id") == "4")
    assert {r["i"]: (r["error"] or "").split(":")[0] for r in got.collect()} == {"a": "Unknown tool", "b": "Invalid argument values", "c": "Invalid username or password", "d": "Record not found", "e": "", "f": "Unknown tool"}


def test_requests_and_counts(spark):
    record = "id: 1, direction: Received, play_count: about 12 plays, like_count: 7, amount: $5, approved_at: 1"
    keep = lambda c: one(spark, c, r=record)
    r = F.col("r")
    assert keep(records.song_filter(r, {"min_play_count": 12, "max_play_count": 12})) and not keep(records.song_filter(r, {"min_play_count": 13}))
    assert keep(records.transaction_filter(r, {"min_like_count": 7})) and not keep(records.transaction_filter(r, {"min_like_count": 8}))
    assert keep(records.request_filter(r, F.lit("venmo__show_received_payment_requests"), "approved")) and not keep(records.request_filter(r, F.lit("venmo__show_sent_payment_requests")))


# folders and sinks


def test_siblings_and_inputs(spark):
    base = new_path(spark, "test-folders")
    for k, said in ((1, "one\ntwo"), (2, "x"), (3, "")):
        spark.createDataFrame([(said,)], "v string").coalesce(1).write.text(f"{base}/d{k}")
    for k, facts in ((1, '{"a": 1}'), (3, "[1]")):
        spark.createDataFrame([(facts,)], "v string").coalesce(1).write.mode("append").option("compression", "none").format("csv").options(sep="\u0001", quote="\u0000").save(f"{base}/d{k}")
    kept, out = folders.with_sibling(folders.scan(spark, base, "*.txt"), folders.scan(spark, base, "*.csv"))
    assert [(r["text"], r["directory"].split("/")[-1], r["sibling"].strip()) for r in kept.collect()] == [("one\ntwo\n", "d1", '{"a": 1}')]
    assert sorted(r["reason"] for r in out.collect()) == ["no object in it", "no sibling"]
    rows, failed = folders.read_each(spark, {"a": f"{base}/d1", "no": f"{base}/none"}, lambda p: spark.read.text(p))
    assert rows.count() > 0 and {r["config"] for r in rows.collect()} == {"a"} and list(failed) == ["no"]
    assert folders.read_each(spark, {"no": f"{base}/none"}, lambda p: spark.read.text(p))[0] is None


def test_sinks_count(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "i long, v int").withColumn("kept", F.lit("clash"))
    whole, part, seen = sinks.write_both(rows, F.col("v") == 1, new_path(spark, "test-both"))
    again = spark.read.schema("i long, v int").json(part)
    assert seen == {"all": 50, "kept": 20} and {r["i"] for r in again.collect()} == {i for i in range(50) if i % 5 and i % 2} and spark.read.json(whole).count() == 50
    target = new_path(spark, "test-rewrite")
    assert sinks.rewrite(again, part, target, F.col("i") > 24) == {"read": 20, "written": 10, "reread": 10}
    for bad in (part, f"{part}/in", whole):
        with pytest.raises(ValueError):
            sinks.rewrite(again, part, bad)
    path = new_path(spark, "test-summary")
    sinks.write_summary(spark.createDataFrame([("a", 1.5, None), ('b"', 2.0, 3)], "k string, x double, n long"), path)
    assert json.loads(spark.read.text(path, wholetext=True).first()[0]) == [{"k": "a", "x": 1.5, "n": None}, {"k": 'b"', "x": 2.0, "n": 3}]
    empty = new_path(spark, "test-summary")
    sinks.write_summary(spark.createDataFrame([], "k string"), empty)
    assert json.loads(spark.read.text(empty, wholetext=True).first()[0]) == []


# first states and rooms


def test_states_begin_with_the_prompt(spark):
    prompt = "## INITIAL SCENE\n- fridge 1 (closed)\n -  side table 2 (open)\n- shelf (open)\n- bed 3 (unknown)\n\n## INITIAL OBJECT LOCATIONS\n- egg 1: in fridge 1\n- pen 2 : on bed 3\n- pen 3: under bed 3\n## RULES\n- cup 1: in sink 1\n"
    prompts = spark.createDataFrame([("a", prompt), ("b", None), ("c", "nothing")], "k string, p string")
    told = replay.events(spark.createDataFrame([("a", 0, "user", "You open the fridge 1. The fridge 1 is open. In it, you see a egg 1, and a tomato 4."), ("a", 1, "user", "You pick up the egg 1 from the fridge 1.")], "k string, t int, role string, c string"), "k", "t", "c")
    (begun,) = replay.final_state(replay.initial(prompts, "k", "p", "t"), "k", "t").collect()
    assert (begun["places"], begun["closed"], begun["opened"], begun["seen"]) == (["bed 3", "fridge 1", "side table 2"], ["fridge 1"], ["side table 2"], ["egg 1", "pen 2"])
    assert begun["contents"] == {"bed 3": ["pen 2"], "fridge 1": ["egg 1"]} and begun["current_loc"] is None and begun["inventory"] == []
    (after,) = replay.final_state(told.unionByName(replay.initial(prompts, "k", "p", "t")), "k", "t").collect()
    assert after["closed"] == [] and after["opened"] == ["fridge 1", "side table 2"] and after["contents"]["fridge 1"] == ["tomato 4"] and after["inventory"] == ["egg 1"]
    assert one(spark, text.listed_places(F.col("v")), v="Around you, you see a bed 1, a side\ntable 2, and a desk 3. You see a cup 9.") == ["bed 1", "desk 3"]
    assert one(spark, text.listed_places(F.col("v")), v=None) == []


def test_goals_read_the_messages_once(spark):
    messages = spark.createDataFrame([("a", 0, "user", "You pick up the mug 1 from the desk 1.")], "k string, t int, role string, c string")
    own = spark.createDataFrame([("a", "pick_and_place_simple", "mug", "desk", "")], "k string, task_type string, target_obj string, destination string, toggle_target string")
    got = replay.goals(replay.events(messages, "k", "t", "c"), own, "k", "t")
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString() and [(r["satisfied"], r["took"]) for r in got.collect()] == [(False, True)]


def test_rooms(spark):
    prompt = "Task: x\n[Kitchen]\n A Stove\nand\n\n[ Hall ]\nx [y]\n\n[kitchen]\nlater\n\n## RULES\n[no]"
    assert one(spark, text.room_map(F.col("p")), p=prompt) == {"kitchen": "later", "hall": "x [y]"}
    assert one(spark, text.room_contents(F.col("p"), F.lit("Kitchen")), p=prompt) == "A Stove\nand" and one(spark, text.room_contents(F.col("p"), F.lit("attic")), p=prompt) == ""
    assert one(spark, text.room_map(F.col("p")), p=None) == {}
    assert one(spark, text.flat_lines(F.col("p")), p=" a\t\n\nthe agent\n b c") == "a b c" and one(spark, text.flat_lines(F.col("p")), p="the agent\n") == "the agent\n"
    rows = [("a", 0, "user", "This room is called the Hall."), ("a", 1, "user", "You move to the den. You are in: it is called the X."), ("a", 2, "assistant", "You move to the sea."), ("a", 3, "user", "it is called the pit."), ("b", 0, "user", None), ("c", 1, "user", "You are in: y. This is called the Loft.")]
    m = spark.createDataFrame(rows, "k string, t int, role string, c string")
    assert {(r["k"], r["room"]) for r in tasks.current_room(m, "k", "t", "role", "c").collect()} == {("a", "den"), ("b", "unknown"), ("c", "Loft")}
    assert {(r["k"], r["room"]) for r in tasks.first_room(m, "k", "t", "role", "c").collect()} == {("a", "hall"), ("b", "hallway"), ("c", "loft")}


# streams of several batches


def test_stream_over_batches_forgets_and_drops_late_rows(spark):
    start, path = datetime(2024, 1, 1), new_path(spark, "test-stream")
    at = lambda days, minutes=0: start + timedelta(days=days, minutes=minutes)
    batches = [
        [("a", at(0, i), i, "x" + str(i), True) for i in range(3)] + [("b", at(0, i), 10 + i, "y" + str(i), True) for i in range(3)],
        [("b", at(1), 20, "z", True), ("c", at(1), 21, "w", False)],  # the fourth of b in a row, in another batch
        [("c", at(40), 30, "w", False)],
        [("c", at(41), 31, "w", False), ("a", at(0, 9), 32, "late", True)],  # late: dropped
        [("a", at(42), 40, "v", True), ("c", at(42), 41, "w", False)],  # a was forgotten; c is three of a kind since it began anew
    ]
    schema = "rid string, ts timestamp, event_id long, action string, nothing boolean"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    out = new_path(spark, "test-stream-out")
    stream = kills.kills(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    assert sorted((r["rid"], r["turn"], r["kill"]) for r in spark.read.parquet(out).collect()) == [("b", 4, "stuck"), ("c", 3, "loop")]


# app rollouts


def test_rollouts_are_read_from_their_texts(spark):
    say = lambda k, t, name, args: (k, t, "assistant", f'<think>[{{"name": "no"}}]</think>[{{"name": "{name}", "parameters": {json.dumps(args)}}}]')
    back = lambda k, t, text_: (k, t, "user", f"<tool_response>\n{text_}\n</tool_response>")
    rows = [
        say("a", 0, "spotify__login", {"password": "secret-1"}), back("a", 1, '{"error": "no"}'),
        say("a", 2, "supervisor__show_account_passwords", {}), back("a", 3, '[{"password": "secret-1"}]'),
        say("a", 4, "spotify__login", {"username": "abc", "password": "secret-1"}), back("a", 5, "ok"),
        say("a", 6, "bogus", {"x": {"type": "string", "y": 1}}), back("a", 7, ""), back("a", 8, "Traceback here"),
        say("a", 9, "supervisor__complete_task", {"answer": 12}),
        ("b", 0, "user", "no response"), ("b", 1, "assistant", None), say("b", 2, "spotify__login", {"password": "secret-1"}),
        ("c", 0, "tool", "<tool_response> unclosed"),
    ]
    messages = spark.createDataFrame(rows, "k string, t int, role string, content string")
    ends = spark.createDataFrame([("a", "Well [then] {", None, "10"), ("b", '```[{"name": "bogus"}]```', "do not DECLINE", None), ("c", None, "x", ""), ("d", '{"name": "supervisor__complete_task", "arguments": {"answer": "Yes, Gold"}}', None, "gold")], "k string, completion string, instruction string, truth string")
    tools = spark.createDataFrame([("spotify__login",), ("supervisor__show_account_passwords",), ("supervisor__complete_task",)], "tool string")
    from trailmill.operators import rollouts

    told = rollouts.facts(messages, ends, tools, "k", "t", "role", "content")
    got = {r["k"]: r.asDict() for r in told.collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a["responses"], a["successes"], a["data"], a["calls"], a["repeated"], a["names"]) == (5, 2, 0, 5, 1, 5)
    assert a["credentials"] and a["placeholder"] and a["schema_args"] and a["password"] and a["acted"] and a["completed"] and not a["final_call"]
    assert (a["answer"], a["invalid_ratio"], a["form"], a["preamble"]) == ("12", 0.2, 0.0, 0)
    assert not b["credentials"] and (b["responses"], b["names"], b["invalid_ratio"], b["preamble"]) == (0, 2, 0.5, 4) and b["form"] == pytest.approx(0.16)
    assert (c["responses"], c["successes"], c["names"], c["final_call"]) == (1, 1, 0, False)
    assert (d["answer"], d["completed"], d["final_call"]) == ("Yes, Gold", True, True) and d["form"] == pytest.approx(0.7)
    reward = {r["k"]: r["reward"] for r in rollouts.app_rewards(told, "k").collect()}
    assert reward["a"] == pytest.approx(0.25 * (1 - 0.2) * 0.8 * 0.2 * 0.3 * 0.0) and reward["d"] == pytest.approx(0.7)
    assert reward["b"] == pytest.approx(0.05 * 0.5 * 0.5) and reward["c"] == pytest.approx(0.6 * 0.1 * 0.3 * 0.5)


def test_word_masks_within_a_budget():
    from trailmill.operators import scoring

    rng = random.Random(1)
    for _ in range(30):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randrange(40))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert scoring.lcs_length(a, b) == scoring.lcs_length(a, b, 0) == table[-1][-1]


def test_rooms_of_a_long_prompt(spark):
    """Thousands of blocks of few rooms: their cost grows with the blocks, not with pairs of them; the last block of a room counts, the first is found."""
    rooms = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.concat(F.lit("[Room "), (i % 50).cast("string"), F.lit("]\nthing "), i.cast("string"))), "\n\n")
    got = spark.range(1).select(text.room_blocks(rooms).alias("b")).select(text.rooms_of(F.col("b")).alias("r"), text.contents_of(F.col("b"), F.lit("Room 7")).alias("c"))
    began = time.time()
    row = got.first()
    assert {r["key"]: r["value"] for r in row["r"]} == {f"room {i}": f"thing {59_950 + i}" for i in range(50)} and row["c"] == "thing 7"
    assert time.time() - began < 60


def test_packed_folders(spark):
    """A packed folder gives the rows that a loose one gives; as many folders as there are files take few files on disk."""
    rows = [("a/x.txt", "one\ntwo\n"), ("a/y.csv", "{}"), ("b/x.txt", ""), ("b/c/x_txt", "no"), ("c/z.csv", None), *((f"d{i}/x.txt", f"text {i}") for i in range(3000))]
    base = new_path(spark, "test-packed")
    folders.pack(spark.createDataFrame(rows, "path string, text string").coalesce(2), base)
    got = sorted(tuple(r) for r in folders.scan_packed(spark, base, "*.txt").collect())
    assert got == sorted((f"{base}/{p}", f"{base}/{p}".rsplit("/", 1)[0], p.rsplit("/", 1)[1], t) for p, t in rows if p.endswith(".txt"))
    assert [(r["path"].split("/")[-2:], r["text"]) for r in folders.scan_packed(spark, base, "?.csv").collect()] == [(["a", "y.csv"], "{}")]
    assert folders.scan_packed(spark, base, "x_txt").count() == 1 and folders.scan_packed(spark, base, "x.tx").count() == 0
    kept, out = folders.with_sibling(folders.scan_packed(spark, base, "*.txt"), folders.scan_packed(spark, base, "*.csv"))
    assert [(r["directory"].split("/")[-1], r["sibling"]) for r in kept.collect()] == [("a", "{}")] and out.count() == 3001
    assert len(spark.read.parquet(base).inputFiles()) == 2


@pytest.mark.parametrize("name", ["folder_tasks", "folder_skipped"])
def test_pages_as_files(spark, monkeypatch, name):
    """Odd pages (none, repeated, without html) are what the SQL says, and a page is no file of its own on disk."""
    base, path = new_path(spark, "test-pages"), new_path(spark, "test-page-folders")
    monkeypatch.setattr(jobs, "new_path", lambda spark, name: path)
    spark.createDataFrame([(None, "u", "x"), (1, "u", None), (7, "u", None), (11, "u", "x"), *((i % 290, "u", "x" * i) for i in range(300))], "page_id long, url string, html string").coalesce(1).write.parquet(f"{base}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{base}/pages.parquet/*.parquet'")
    got = jobs.QUERIES[name](spark, base)
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({jobs.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 60
    assert sum(len(files) for _, _, files in os.walk(path)) < 20
