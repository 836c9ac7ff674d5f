"""Event-sourced world state from observation texts, and goal predicates over it.

Texts become one row for each event (turn, rank of the pattern, place in the text), by regular
expressions in SQL. Each event adds names to sets, takes them out, or empties a set; a state is then what was added after it
was last taken out, which windows and groupings tell without going through the events one by one. Goals are joins of event sets.

Null texts tell nothing; a trajectory without events has no state. Equal rows are one event each, as if told twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.text import heading, split_listed, strip
from trailmill.shared import stored

THING = r"([\w ]+\d+)"
#: What observations say, in the order in which a message's events apply: kind, pattern, groups (a thing, then a place or a list).
PHRASES = [
    ("go_closed", rf"You arrive at {THING}\. The \1 is closed\.", 1),
    ("go_open", rf"(?s)You arrive at {THING}\. On the \1, you see (.+?)\.", 2),
    ("go_near", rf"(?s)You arrive at {THING}\. On the (?!\1,)[^,]+, you see (.+?)\.", 2),
    ("go_nothing", rf"You arrive at {THING}\. On the \1, you see nothing\.", 1),
    ("open", rf"(?s)You open the {THING}\. The \1 is open\. In it, you see (.+?)\.", 2),
    ("open_empty", rf"You open the {THING}\. The \1 is open\. In it, you see nothing\.", 1),
    ("close", rf"You close the {THING}\.", 1),
    ("take", rf"You pick up the {THING} from the {THING}\.", 2),
    ("put", rf"You (?:move|put) the {THING} (?:to|in/on|in|on) the {THING}\.", 2),
    ("clean", rf"You clean the {THING} using the {THING}\.", 2),
    ("heat", rf"You heat the {THING} using the {THING}\.", 2),
    ("cool", rf"You cool the {THING} using the {THING}\.", 2),
    ("slice", rf"You slice the {THING} using the {THING}\.", 2),
    ("use", rf"You turn on the {THING}\.", 1),
]
#: The flag that a kind of event gives to its object.
FLAGS = {"clean": "clean", "heat": "hot", "cool": "cool", "slice": "sliced", "use": "on"}


def _told(rank: int, kind: str, things: Column, others: Column | None) -> Column:
    """An event for each thing with what stands at its place in ``others``. Both are zipped, as a list that a lambda reads by place would be searched for again at each place."""
    pairs = F.zip_with(things, F.array().cast("array<string>") if others is None else others, lambda t, o: F.struct(t.alias("thing"), o.alias("other")))
    return F.transform(pairs, lambda p, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), F.lit(kind).alias("kind"), p["thing"].alias("thing"), p["other"].alias("other")))


def events(messages: DataFrame, key: str, turn: str, content: str, role: str | None = "role", roles: tuple[str, ...] = ("user", "tool")) -> DataFrame:
    """key, turn, rank, pos, kind, thing, other: a row for each event in each message of the roles named (None: of all)."""
    rows = messages.where(F.col(role).isin(*roles)) if role and roles else messages
    found, text = [], F.col(content)
    for rank, (kind, pattern, groups) in enumerate(PHRASES):
        # A text without the pattern's first words is not searched.
        told = F.contains(text, F.lit("You ")) if kind == "put" else F.contains(text, F.lit(pattern.removeprefix("(?s)").split(THING)[0]))
        things, others = (F.when(told, F.regexp_extract_all(text, F.lit(pattern), F.lit(k))).otherwise(F.array().cast("array<string>")) for k in (1, groups))
        found.append(_told(rank, kind, things, others if groups == 2 else None))
    return rows.select(key, turn, F.explode(F.concat(*found)).alias("e")).select(key, turn, "e.*")


#: Kinds of event that tell what is in a place.
LISTS = ("go_open", "go_near", "open")
#: The headings of a prompt that tell how things stand at first, and the lines under them: a place with its state, and a thing with its place.
SCENE, LOCATIONS = "## INITIAL SCENE", "## INITIAL OBJECT LOCATIONS"
SCENE_LINE = r"(?mU)^[^\S\n]*-[^\S\n]+([\w ]+\d+)[^\S\n]*\((open|closed|unknown)\)"
LOCATION_LINE = r"(?mU)^[^\S\n]*-[^\S\n]+([\w ]+\d+)[^\S\n]*:[^\S\n]*(?:in|on)[^\S\n]+([\w ]+\d+)"


def initial(prompts: DataFrame, key: str, prompt: str, turn: str, before: int = -1) -> DataFrame:
    """What a prompt tells of the world before any message, in the form of ``events`` at turn ``before``: places with their state, and things with their place. Put together with ``events`` it gives states a beginning."""
    scene, located = heading(F.col(prompt), SCENE), heading(F.col(prompt), LOCATIONS)

    def lines(text: Column, pattern: str) -> list[Column]:
        return [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)), strip) for k in (1, 2)]

    places, states = lines(scene, SCENE_LINE)
    things, where = lines(located, LOCATION_LINE)

    first = F.transform(_told(0, "scene_", places, states), lambda e: F.struct(e["rank"].alias("rank"), e["pos"].alias("pos"), F.concat(e["kind"], e["other"]).alias("kind"), e["thing"].alias("thing"), F.lit(None).cast("string").alias("other")))
    then = _told(1, "located", things, where)
    return prompts.select(key, F.lit(before).alias(turn), F.explode(F.concat(first, then)).alias("e")).select(key, turn, "e.*")


def changes(found: DataFrame, key: str, turn: str) -> DataFrame:
    """key, at, what, place, name, how: what each event adds to a set, takes out of it (gone), or empties (clear).

    Sets: loc (places come to, the last one counts), known (places that a prompt lists), door (open things), told (things known to be open or closed), held, seen, in (by place),
    flag (by thing). An item that a loose arrival names without a number is the only numbered one of its class seen so far, if there is one.
    """
    kind, thing, other = F.col("kind"), F.col("thing"), F.col("other")
    empty = kind.isin("go_nothing", "open_empty") | ((kind == "go_near") & (F.lower(F.trim(other)) == "nothing"))
    items = F.when(kind.isin(*LISTS) & ~empty, split_listed(other))

    def change(what: str, place: Column, name: Column, how: str, idx: Column | None = None) -> Column:
        return F.struct(F.lit(what).alias("what"), place.alias("place"), name.alias("name"), F.lit(how).alias("how"), (F.lit(-1) if idx is None else idx).alias("idx"))

    def when(case: Column, *rows: Column) -> Column:
        return F.when(case, F.array(*rows))

    no = F.lit("")
    flag = F.try_element_at(F.create_map(*(F.lit(x) for pair in FLAGS.items() for x in pair)), kind)
    told = [
        when(F.startswith(kind, F.lit("go")), change("loc", no, thing, "add")),
        when(kind == "go_closed", change("door", no, thing, "gone"), change("told", no, thing, "add")),
        when(kind.isin(*LISTS, "open_empty"), change("door", no, thing, "add"), change("told", no, thing, "add")),
        when(kind == "close", change("door", no, thing, "gone")),
        when(F.startswith(kind, F.lit("scene_")), change("known", no, thing, "add")),
        when(kind == "scene_open", change("door", no, thing, "add"), change("told", no, thing, "add")),
        when(kind == "scene_closed", change("door", no, thing, "gone"), change("told", no, thing, "add")),
        when(kind == "located", change("in", other, thing, "add"), change("seen", no, thing, "add")),
        when(empty, change("in", thing, F.lit(None).cast("string"), "clear")),
        F.transform(items, lambda i, n: change("seen", no, i, "add", n)),
        F.transform(items, lambda i, n: change("in", thing, i, "add", n)),
        when(kind == "take", change("held", no, thing, "add"), change("in", other, thing, "gone"), change("seen", no, thing, "add")),
        when(kind == "put", change("held", no, thing, "gone"), change("in", other, thing, "add"), change("seen", no, thing, "add")),
        when(flag.isNotNull(), change("flag", thing, flag, "add")),
    ]
    rows = found.select(key, turn, "rank", "pos", "kind", F.explode(F.flatten(F.array_compact(F.array(*told)))).alias("c")).select(key, "kind", F.struct(turn, "rank", "pos", "c.idx").alias("at"), "c.what", "c.place", "c.name", "c.how")
    numbered = F.col("name").rlike(r"\d\z")
    before = W.partitionBy(key, F.regexp_replace("name", r" \d+\z", "")).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    known = F.when(numbered & (F.col("what") == "seen"), F.col("name"))
    loose = (F.col("kind") == "go_near") & F.col("what").isin("seen", "in") & ~numbered
    rows = rows.withColumn("low", F.min(known).over(before)).withColumn("high", F.max(known).over(before))
    return rows.withColumn("name", F.when(loose & (F.col("low") == F.col("high")), F.col("low")).otherwise(F.col("name"))).select(key, "at", "what", "place", "name", "how")


def final_state(found: DataFrame, key: str, turn: str) -> DataFrame:
    """key, current_loc, places, inventory, opened, closed, contents, flags, seen after all events: a row for each trajectory. ``places``: those that a prompt lists (``initial``).

    Held things stand in the order in which they were taken, contents in the order in which they came; the other sets by name.
    Events are dealt by trajectory once; what they change, some rows for each, is made, ordered and grouped where they then lie.
    """
    at, how = F.col("at"), F.col("how")
    place, name = W.partitionBy(key, "what", "place"), W.partitionBy(key, "what", "place", "name")
    rows = changes(found.repartition(key), key, turn).withColumn("cleared", F.max(F.when(how == "clear", at)).over(place)).withColumn("gone", F.max(F.when(how == "gone", at)).over(name))
    stays = (how == "add") & (F.col("cleared").isNull() | (at > F.col("cleared"))) & (F.col("gone").isNull() | (at > F.col("gone")))
    one = rows.groupBy(key, "what", "place", "name").agg(F.min(F.when(stays, at)).alias("since"), F.max(at).alias("last"), F.max(how != "gone").alias("kept"))
    timed = F.col("what").isin("held", "in")
    entry = F.struct(F.when(timed, F.col("since")).alias("since"), "name")
    sets = one.groupBy(key, "what", "place").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("since").isNotNull(), entry))), lambda e: e["name"]).alias("names"), F.max_by("name", "last").alias("latest"), F.max("kept").alias("kept"))

    def of(what: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("what") == what, F.col("names"))), F.array().cast("array<string>"))

    def by_place(what: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("what") == what) & F.col("kept"), F.struct("place", "names")))))

    got = sets.groupBy(key).agg(
        F.max(F.when(F.col("what") == "loc", F.col("latest"))).alias("current_loc"), of("known").alias("places"), of("held").alias("inventory"), of("door").alias("opened"), of("told").alias("told"),
        by_place("in").alias("contents"), by_place("flag").alias("flags"), of("seen").alias("seen"),
    )
    return got.select(key, "current_loc", "places", "inventory", "opened", F.array_except("told", "opened").alias("closed"), "contents", "flags", "seen")


def cls(thing: Column) -> Column:
    return F.lower(F.substring_index(thing, " ", 1))


def goals(found: DataFrame, tasks: DataFrame, key: str, turn: str) -> DataFrame:
    """key, satisfied, took, placed, transformed, toggled. tasks: key, task_type, target_obj, destination, toggle_target (lower case).

    A task counts as done if its object was placed (two of them, or one that was cleaned, heated, cooled at any time),
    or if the lamp was turned on while the object was held. An object without a target is never done. Events are stored once, as three parts of the answer read them.
    """
    e = stored(found, "events").join(tasks, key)
    target, place = cls(F.col("thing")) == F.col("target_obj"), cls(F.col("other")) == F.col("destination")
    lamp = (F.col("kind") == "use") & F.contains(F.col("thing"), F.col("toggle_target")) & (F.col("toggle_target") != "")
    at = F.struct(turn, "rank", "pos")
    moves = e.where(F.col("kind").isin("take", "put") & target).select(key, "thing", "kind", at.alias("since"))
    until = F.min(F.when(F.col("kind") == "put", F.col("since"))).over(W.partitionBy(key, "thing").orderBy("since").rowsBetween(1, W.unboundedFollowing))
    holds = moves.withColumn("until", until).where("kind = 'take'").select(key, "since", "until")
    lit = e.where(lamp).select(key, at.alias("at")).join(holds, key).where((F.col("at") > F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))).select(key, F.lit(True).alias("lit")).distinct()
    sets = e.groupBy(key).agg(
        F.collect_set(F.when((F.col("kind") == "put") & target & place, F.col("thing"))).alias("put"), *(F.collect_set(F.when(F.col("kind") == k, F.col("thing"))).alias(k) for k in ("clean", "heat", "cool")),
        F.max((F.col("kind") == "take") & target).alias("took"), F.max((F.col("kind") == "put") & place).alias("any_put"), F.max(lamp).alias("toggled"),
        *(F.max((F.col("kind") == k) & target).alias(f"{k}ed") for k in ("clean", "heat", "cool")),
    )
    own = tasks.join(sets, key, "left").join(lit, key, "left")
    kind = F.col("task_type")
    done = F.when(kind == "look_at_obj_in_light", F.col("lit")).when(kind == "pick_two_obj_and_place", F.size("put") >= 2)
    for k in ("clean", "heat", "cool"):
        done = done.when(kind == f"pick_{k}_then_place_in_recep", F.arrays_overlap("put", k))
    done = done.otherwise(F.size("put") > 0)
    transformed = F.lit(False)
    for k in ("clean", "heat", "cool"):
        transformed = transformed | ((kind == f"pick_{k}_then_place_in_recep") & F.col(f"{k}ed"))

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return own.select(key, (sure(done) & (F.coalesce("target_obj", F.lit("")) != "")).alias("satisfied"), sure(F.col("took")).alias("took"), sure(F.col("any_put")).alias("placed"), sure(transformed).alias("transformed"), sure(F.col("toggled") & (kind == "look_at_obj_in_light")).alias("toggled"))


def listing_order(items: Column) -> Column:
    """By class, then by number from the highest."""
    ranked = F.transform(items, lambda o: F.struct(F.substring_index(o, " ", 1).alias("c"), (-F.coalesce(F.substring_index(o, " ", -1).try_cast("int"), F.lit(0))).alias("n"), o.alias("o")))
    return F.transform(F.array_sort(ranked), lambda s: s["o"])
