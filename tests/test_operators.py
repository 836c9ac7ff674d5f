"""Hand-made cases: expected values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from trailmill.functions import jsonx, text
from trailmill.operators import chat, records, replay, rewards, scoring, trajectory
from trailmill.sources import chat_jsonl


def one(spark, column, **values):
    schema = [*values] if None not in values.values() else ", ".join(f"{k} string" for k in values)
    row = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "block", "windowed", "ar"),
    [
        ("<think>x</think>hello", "hello", "xhello", "xhello"),
        ('<tool_response>\n {"b":2,"a":1} \n</tool_response>', '{"a":1,"b":2}', '{"a":1,"b":2}', '{"a": 1, "b": 2}'),
        ("pre<tool_response>in</tool_response>post", "in", "in", "preinpost"),
        ("</think> ok", "ok", "ok", "ok"),
        ("<think>a<tool_response>b</tool_response></think>c", "c", "b", "abc"),
        ('{"a":1} x', '{"a":1} x', '{"a":1} x', '{"a":1} x'),
        ('{"a":1,"a":2}', '{"a":2}', '{"a":2}', '{"a": 2}'),
        ("[1.0, 1.50]", "[1.0,1.5]", "[1.0,1.5]", "[1.0, 1.5]"),
    ],
)
def test_clean(spark, said, block, windowed, ar):
    got = spark.createDataFrame([(said,)], ["t"]).select(*(scoring.clean(F.col("t"), p).alias(p) for p in ("block", "windowed", "ar"))).first()
    assert (got["block"], got["windowed"], got["ar"]) == (block, windowed, ar)


def test_semantic_equality(spark):
    pairs = [("1.0", "1", True), ("true", "1", True), ("x", "x", True), ("x", "y", False), ('{"a":1}', '{"a": 1.0}', True), (None, "1", False)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(jsonx.semantic_equal("a", "b").alias("s")).collect()
    assert [r["s"] for r in got] == [p[2] for p in pairs]


LINES = ['{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', '[{"role":"user","content":"bare"}]', "", "not json", '{"messages":[]}', '{"messages":[{"role":"user"}]}', '"str"', '{"messages":"[{\\"role\\":\\"user\\",\\"content\\":\\"x\\"}]"}']


@pytest.mark.parametrize(("passthrough", "n"), [(False, 2), (True, 1)])
def test_lenient_chats(spark, tmp_path, passthrough, n):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES) + "\n")
    got = chat_jsonl.counters(chat_jsonl.read(spark, str(tmp_path / "a.jsonl"), passthrough)).first()
    assert (got["n_in"], got["n_out"], got["n_skipped"]) == (8, n, 8 - n)


def test_predictions_and_missing_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"index":0,"predicted":"p","expected":"e"}\n\nbroken\n')
    got = chat_jsonl.read_present(spark, f"{tmp_path}/{{name}}.jsonl", ["a", "b"], chat_jsonl.predictions).collect()
    assert [(r["dataset"], r["prediction"], r["reference"]) for r in got if r["index"] == 0] == [("a", "p", "e")]


def test_chats_round_trip(spark, tmp_path):
    chats = spark.createDataFrame([(1, [("user", "a\nb"), ("assistant", None)])], f"id int, messages {chat.MESSAGES}")
    chat_jsonl.write_chats(chats, str(tmp_path / "out"), bare=True)
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '[{"role":"user","content":"a\\nb"},{"role":"assistant","content":null}]'


def test_summary(spark):
    rows = [(0, '{"b":2,"a":1}', '{"a": 1, "b": 2}', 0), (0, "dup", "dup", 1), (1, "ERROR: boom", "x", 2), (2, "foo", "   ", 3), (3, "1.0", "1", 4), (4, "a", "b", 5)]
    df = spark.createDataFrame(rows, "index int, prediction string, reference string, pos int").withColumn("config", F.lit("d"))
    got = scoring.summary(scoring.score(scoring.keep_first(df, ["index"], [F.col("pos")])), "config").first()
    assert (got["num_samples"], got["num_dropped_errors"], got["num_empty_ref_dropped"]) == (3, 1, 1)
    assert (got["exact_match"], got["semantic_match"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3))


def test_rouge_l_is_the_table(spark):
    rng, cases = random.Random(3), []
    for _ in range(30):
        a, b = (" ".join(rng.choice("xyz") for _ in range(rng.randint(0, 7))) for _ in range(2))
        p, r = a.split(), b.split()
        t = [[0] * (len(r) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(r):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        cases.append((a, b, 2 * t[-1][-1] / (len(p) + len(r)) if p or r else 0.0))
    got = spark.createDataFrame(cases, "a string, b string, f double").select(scoring.rouge_l(F.col("a"), F.col("b")).alias("x"), "f").collect()
    assert all(g["x"] == pytest.approx(g["f"]) for g in got)


PROMPT = """Intro
  songs (3 total):
    - id: 1, title: Blue, genre: Rock, play_count: 10, release_date: 2020-01-02, liked: True
    - id: 2, title: Red, Green, genre: pop, play_count: 5, liked: False
    - id: 3, title: Sun, genre: rock, release_date: 2021-05-05, liked: True
  albums (0 total):
"""


@pytest.mark.parametrize(("args", "ids"), [({"genre": "rock"}, ["1", "3"]), ({"min_play_count": 6}, ["1"]), ({"min_release_date": "2021-01-01"}, ["2", "3"]), ({"liked": True}, ["1", "3"])])
def test_song_filters(spark, args, ids):
    rows = records.records(spark.createDataFrame([(1, PROMPT)], "prompt_id int, prompt string"), "songs")
    got = rows.where(records.song_filter(F.col("record"), args)).orderBy("pos").select(records.to_map(F.col("record"))["id"].alias("id")).collect()
    assert [r["id"] for r in got] == ids


def test_comma_in_value_and_types(spark):
    rows = records.records(spark.createDataFrame([(1, PROMPT)], "prompt_id int, prompt string"), "songs").orderBy("pos").select(records.to_map(F.col("record")).alias("m")).collect()
    assert rows[1]["m"]["title"] == "Red, Green"
    got = spark.createDataFrame([(x,) for x in ("3", "-1.5", "True", "None", "[1]", "word")], ["v"]).select(records.typed(F.col("v"))["kind"].alias("k")).collect()
    assert [r["k"] for r in got] == ["int", "float", "bool", "null", "literal", "text"]


@pytest.mark.parametrize(("index", "limit", "places"), [(2, 5, [11, 12]), (9, 5, [None]), (0, 50, [*range(1, 13)]), (0, 0, [1])])
def test_paging(spark, index, limit, places):
    got = records.page(spark.range(12), [], [F.col("id")], index, limit).orderBy("pos").collect()
    assert [r["pos"] for r in got] == places and {r["total"] for r in got} == {12}


def test_page_args(spark):
    got = spark.createDataFrame([("-1", "x"), (None, None), ("2", "50"), ("a", "0")], "i string, l string").select(*(c.alias(n) for n, c in zip("il", records.page_args(F.col("i"), F.col("l")), strict=True))).collect()
    assert [(r["i"], r["l"]) for r in got] == [(0, 5), (0, 5), (2, 20), (0, 1)]


def test_loops(spark):
    rows = spark.createDataFrame([("t", i, a) for i, a in enumerate("AAALBLB")], "k string, n0 int, a string")
    got = trajectory.quality(rows, "k", ["n0"], "a", F.lit(False)).first()
    assert (got["n_aaa"], got["max_repeat"], got["n_abab"], got["n_actions"]) == (1, 3, 1, 7)


STORY = ["You arrive at desk 1. On the desk 1, you see a mug 1, and a pen 2.", "You pick up the mug 1 from the desk 1.", "You arrive at drawer 1. The drawer 1 is closed.", "You open the drawer 1. The drawer 1 is open. In it, you see nothing.", "You move the mug 1 to the drawer 1."]


def test_replay_and_goals(spark):
    rows = spark.createDataFrame([("e", i, "user", s) for i, s in enumerate(STORY)], "k string, turn int, role string, content string")
    found = replay.events(rows, "k", "turn", "content")
    state = replay.final_state(found, "k", "turn").first()
    assert state["current_loc"] == "drawer 1" and state["inventory"] == []
    assert state["contents"] == {"desk 1": ["pen 2"], "drawer 1": ["mug 1"]}
    assert (state["opened"], state["closed"]) == (["desk 1", "drawer 1"], []) and "nothing" in state["seen"]
    for kind, done in (("pick_and_place_simple", True), ("pick_clean_then_place_in_recep", False), ("pick_two_obj_and_place", False)):
        task = spark.createDataFrame([("e", kind, "mug", "drawer", "")], "k string, task_type string, target_obj string, destination string, toggle_target string")
        assert replay.goals(found, task, "k", "turn").first()["satisfied"] is done


@pytest.mark.parametrize(
    ("score", "n", "focus", "reps", "reward"), [(-100.0, 3, True, 0, -0.2), (-10.0, 5, False, 0, -0.1), (50.0, 12, False, 0, -0.15), (100.0, 5, True, 1, 0.85)]
)
def test_science_reward(spark, score, n, focus, reps, reward):
    assert one(spark, rewards.science(F.lit(score), F.lit(n), F.lit(focus), F.lit(reps))) == pytest.approx(reward)


def test_household_reward(spark):
    no, yes = F.lit(False), F.lit(True)
    assert one(spark, rewards.household(no, yes, no, no, no, F.lit(3), F.lit(1.0))) == pytest.approx(0.03)
    assert one(spark, rewards.household(yes, yes, yes, no, no, F.lit(9), rewards.household_penalty(F.lit(3), F.lit(0), F.lit(0), F.lit(9)))) == pytest.approx(0.7)
    assert one(spark, rewards.number_credit(F.lit(8), F.lit(10))) == pytest.approx(0.2)


@pytest.mark.parametrize(
    ("said", "verb", "obj", "place"),
    [("<think>a</think>\nAction: Take the mug 1 from the desk 2.", "take", "mug 1", "desk 2"), ("look\nmore", "look", None, None), ("Move mug 1", "put", "mug 1", None), ("cool egg 1 with fridge 1", "cool", "egg 1", "fridge 1"), ("dance", None, None, None),
     ("<<wm>> <<x y>> Action: take mug 1 from desk 1.", "take", "mug 1", "desk 1"), ("look around", None, None, None), ("Look at the desk 1", "examine", "desk 1", None), ("put a cup 2 in/on an old shelf 1", "put", "cup 2", "old shelf 1"),
     ("open", None, None, None), ("inventory", "inventory", None, None), ("take mug-1 from desk 1", None, None, None), ("", None, None, None)],
)
def test_actions(spark, said, verb, obj, place):
    got = one(spark, text.verb_slots(text.parse_action(F.col("t"))), t=said)
    assert (got["verb"], got["object"], got["place"]) == (verb, obj, place)


LATER = [
    "You arrive at desk 1. On the desk 1, you see a mug 1, and a pen 2. You turn on the lamp 1.", "You arrive at shelf 1. On the board, you see a mug, and a cup.", "You pick up the pen 2 from the desk 1.", "You pick up the mug 1 from the desk 1.",
    "You put the pen 2 in/on the desk 1.", "You arrive at box 1. The box 1 is closed.", "You arrive at rack 1. On the stand, you see nothing.", "You close the desk 1. You close the sofa 1.", "You clean the mug 1 using the sink 1. You heat the mug 1 using the oven 1.", None,
]


def test_replay_adds_takes_and_empties(spark):
    """By hand: a loose arrival's mug is mug 1, its cup is none that was seen; nothing is no thing; only open things close."""
    rows = spark.createDataFrame([("e", i, "user", s) for i, s in enumerate(LATER)], "k string, turn int, role string, content string")
    for same in (rows, rows.repartition(5, "content")):
        state = replay.final_state(replay.events(same, "k", "turn", "content"), "k", "turn").first()
        assert (state["current_loc"], state["inventory"]) == ("rack 1", ["mug 1"])
        assert state["contents"] == {"desk 1": ["pen 2"], "shelf 1": ["mug 1", "cup"], "rack 1": []}
        assert (state["opened"], state["closed"]) == (["rack 1", "shelf 1"], ["box 1", "desk 1"])
        assert (state["flags"], state["seen"]) == ({"lamp 1": ["on"], "mug 1": ["clean", "hot"]}, ["cup", "mug 1", "pen 2"])
    assert replay.final_state(replay.events(rows.limit(0), "k", "turn", "content"), "k", "turn").count() == 0


@pytest.mark.parametrize(
    ("said", "action"),
    [("<think>x</think>```py\nopen```Action: open door\nmore", "open door"), ("[INST] 'pick up pot'", "pick up pot"), ("12.5", ""), ("I need to go", ""), ("task is on", "task is on"), ("x" * 201, ""), (None, ""), ("<b>wait</b>", "wait"), ("scores are in", "")],
)
def test_science_actions(spark, said, action):
    assert one(spark, text.science_action(F.col("t")), t=said) == action


@pytest.mark.parametrize(("said", "action"), [("1. `open door`\nand", "open door"), ("- Action: look around", "look around"), ("2) > wait", "wait"), (None, ""), ("  ", "")])
def test_demo_actions(spark, said, action):
    assert one(spark, text.demo_action(F.col("t")), t=said) == action


NOTHING = "Nothing happens."


@pytest.mark.parametrize(
    ("said", "seen"),
    [("<think>x</think><tool_response>You see.</tool_response>", "You see."), ("```You see.```", "You see."), ('["a b "]', "a b"), ('[{"content": "plain"}]', "plain"), ('[{"content": "[{\\"type\\": \\"text\\", \\"text\\": \\" hi \\"}]"}]', "hi"),
     ('[{"content": "\\"in\\""}]', "in"), ("[not json", "[not json"), ("[]", "[]"), ('[{"other": 1}]', '[{"other": 1}]'), ('[""]', NOTHING), ("", NOTHING), (None, NOTHING)],
)
def test_observations(spark, said, seen):
    assert one(spark, text.observation(F.col("t")), t=said) == seen


def test_small_text_helpers(spark):
    assert one(spark, text.split_listed(F.lit("a mug 1, and a pen 2 and an egg 3"))) == ["mug 1", "pen 2", "egg 3"]
    assert one(spark, text.task_type(F.lit("boil_v2_v10"))) == "boil_v2"
    assert one(spark, text.resolve_instance(F.lit("mug"), F.array(F.lit("pen 1"), F.lit("mug 3")))) == "mug 3"
    assert one(spark, text.has_placeholder(F.array(F.lit("Your_Email here")), ["your_email", "xxx"])) is True
    assert one(spark, replay.listing_order(F.array(F.lit("mug 1"), F.lit("desk 2"), F.lit("mug 10")))) == ["desk 2", "mug 10", "mug 1"]


def test_tool_calls(spark):
    said = ['[play(song="a", n=2)]', '<tool_call>{"name": "x", "parameters": {"b": 1}}</tool_call>', '[{"name": "y", "arguments": "{\\"c\\": 3}"}]', "none"]
    got = spark.createDataFrame([(s,) for s in said], ["t"]).select(jsonx.tool_call("t").alias("c")).select("c.*").collect()
    assert [(r["name"], r["arguments"]) for r in got] == [("play", '{"n": 2, "song": "a"}'), ("x", '{"b": 1}'), ("y", '{"c": 3}'), (None, None)]


def test_sections_and_blocks(spark):
    assert one(spark, chat.swap_first_block(F.lit("a<t>1</t>b<t>2</t>"), "<t>", "</t>", F.lit("N"))) == "a<t>N</t>b<t>2</t>"
    assert one(spark, chat.replace_section(F.lit("x\n## S\nold\n## D\ny"), "## S", "## D", F.lit("new"))) == "x\n## S\nnew\n## D\ny"
    assert one(spark, chat.replace_section(F.lit("x\n## D\ny"), "## S", "## D", F.lit("new"))) == "x\n## S\nnew\n## D\ny"


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], "k string, n0 int, a string")
    assert trajectory.quality(none, "k", ["n0"], "a", F.lit(False)).count() == 0
    assert records.page(spark.range(0), [], [F.col("id")]).first()["total"] == 0
    assert one(spark, text.parse_action(F.lit(None).cast("string"))) is None


def test_states_are_dealt_once(spark):
    """Events are shuffled by trajectory and what they change is not: it is several times as much."""
    rows = spark.createDataFrame([("a", 1, "user", "You pick up the mug 1 from the desk 1."), ("b", 1, "user", "You put the mug 1 on the desk 2.")], "k string, turn int, role string, content string")
    state = replay.final_state(replay.events(rows, "k", "turn", "content"), "k", "turn")
    assert {r["k"]: r["inventory"] for r in state.collect()} == {"a": ["mug 1"], "b": []}
    assert state._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
