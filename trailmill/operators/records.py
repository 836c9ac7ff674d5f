"""Text-record stores: a prompt's sections of record lines, filtered, counted and paged.

A section is ``  name (N total...)`` with lines ``    - key: value, key: value``. Filters come before
paging, and the total counts all that match, so it survives an empty page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.text import normal, record_field, safe_int, strip
from trailmill.operators import ordering

PAGE, MOST = 5, 20


def section(prompt: Column, name: str) -> Column:
    """The lines of a section, without its head; null where the prompt has none."""
    pattern = rf"(?ms)^  {name} \([^\n]*\n((?:    [^\n]*(?:\n|\z))*)"
    return F.when(prompt.rlike(pattern), F.regexp_extract(prompt, pattern, 1))


def section_total(prompt: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(prompt, rf"(?m)^  {name} \((\d+) total", 1), F.lit("")).try_cast("bigint")


def records(prompts: DataFrame, name: str, key: str = "prompt_id", prompt: str = "prompt") -> DataFrame:
    """key, pos, record: a row for each record of the section; lines that don't begin a record belong to the one before."""
    lines = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(section(F.col(prompt), name), r"\n\z", "")), r"\n(?=    - )"), lambda r: F.startswith(r, F.lit("    - ")))
    return prompts.select(key, F.posexplode(lines).alias("pos", "record")).withColumn("record", strip(F.substr("record", F.lit(7))))


def to_map(record: Column) -> Column:
    """Fields by name, as texts; a comma inside a value stays (only ``, key: `` ends one). Of equal names the last counts."""
    pairs = F.transform(F.split(record, r", (?=[a-zA-Z_]+: )"), lambda p: F.struct(F.substring_index(p, ": ", 1).alias("key"), F.substr(p, F.instr(p, F.lit(": ")) + 2).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def typed(value: Column) -> Column:
    """struct(kind, number, flag, text) of a field: int, float, bool, null, or text."""
    kind = F.when(value.isin("None", "null"), "null").when(value.isin("True", "False"), "bool").when(value.rlike(r"\A-?\d+\z"), "int").when(value.rlike(r"\A-?\d+\.\d+\z"), "float").when(value.rlike(r"(?s)\A[\[{].*[\]}]\z"), "literal").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind.isin("int", "float"), value.try_cast("double")).alias("number"), F.when(kind == "bool", value == "True").alias("flag"), value.alias("text"))


def page_args(index: Column, limit: Column) -> tuple[Column, Column]:
    """Index from 0 (default 0), limit 1 to 20 (default 5); what is no number counts as missing."""
    return F.greatest(safe_int(index, 0), F.lit(0)), F.least(F.greatest(safe_int(limit, PAGE), F.lit(1)), F.lit(MOST))


def first_int(value: Column) -> Column:
    """The first integer in a text, as ``12`` in "12 plays"; null where there is none."""
    return F.nullif(F.regexp_extract(value, r"-?\d+", 0), F.lit("")).try_cast("bigint")


def song_filter(record: Column, args: dict) -> Column:
    """Genre, album, artist, substring, inclusive bounds of counts (missing: rejected) and of release dates (missing: kept)."""
    keep = F.lit(True)
    if args.get("genre"):
        keep &= normal(F.coalesce(record_field(record, "genre"), F.lit(""))) == normal(F.lit(args["genre"]))
    for name in ("album_id", "artist_id"):
        if args.get(name) is not None:
            keep &= F.coalesce(safe_int(record_field(record, name)) == int(args[name]), F.lit(False))
    if args.get("query"):
        keep &= F.contains(normal(record), normal(F.lit(args["query"])))
    for name in ("play_count", "like_count"):
        value = first_int(record_field(record, name))
        if f"min_{name}" in args:
            keep &= F.coalesce(value >= int(args[f"min_{name}"]), F.lit(False))
        if f"max_{name}" in args:
            keep &= F.coalesce(value <= int(args[f"max_{name}"]), F.lit(False))
    date = record_field(record, "release_date")
    if args.get("min_release_date"):
        keep &= F.coalesce(date >= args["min_release_date"], F.lit(True))
    if args.get("max_release_date"):
        keep &= F.coalesce(date <= args["max_release_date"], F.lit(True))
    if args.get("liked"):
        keep &= F.contains(record, F.lit("liked: True"))
    return keep


def transaction_filter(record: Column, args: dict) -> Column:
    """Direction, substring, bounds of amount and creation time, least number of likes; a missing or non-numeric field is rejected where it is bounded."""
    keep = F.lit(True)
    if args.get("direction"):
        keep &= normal(record_field(record, "direction")) == normal(F.lit(args["direction"]))
    if args.get("query"):
        keep &= F.contains(normal(record), normal(F.lit(args["query"])))
    amount = F.regexp_extract(F.coalesce(record_field(record, "amount"), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    created = record_field(record, "created_at")
    for name, value in (("amount", amount), ("created_at", created)):
        if f"min_{name}" in args:
            keep &= F.coalesce(value >= args[f"min_{name}"], F.lit(False))
        if f"max_{name}" in args:
            keep &= F.coalesce(value <= args[f"max_{name}"], F.lit(False))
    if "min_like_count" in args:
        keep &= F.coalesce(first_int(record_field(record, "like_count")) >= int(args["min_like_count"]), F.lit(False))
    return keep


def request_filter(record: Column, tool: Column, status: str | None = None) -> Column:
    """Payment requests by direction, which the tool's name says (``..._received_...`` or ``..._sent_...``; any other: both), and by status."""
    way = F.when(F.contains(tool, F.lit("received")), "received").when(F.contains(tool, F.lit("sent")), "sent")
    keep = way.isNull() | F.coalesce(normal(record_field(record, "direction")) == way, F.lit(False))
    return keep & (request_status(record) == status) if status else keep


def request_status(record: Column) -> Column:
    """pending, approved or denied, by the fields that a payment request has."""
    return F.when(F.contains(record, F.lit("approved_at:")), "approved").when(F.contains(record, F.lit("denied_at:")), "denied").otherwise("pending")


def directory_filter(record: Column, path: str | None = None, substring: str | None = None, entry_type: str | None = None) -> Column:
    keep = F.lit(entry_type != "files")
    for part in (path, substring):
        if part:
            keep &= F.contains(normal(record), normal(F.lit(part)))
    return keep & F.contains(record, F.lit("tilde_path:")) if entry_type == "directories" else keep


def note_filter(record: Column, query: str) -> Column:
    """Substring over title, content and tags only."""
    return F.contains(normal(F.concat_ws(" ", *(record_field(record, f) for f in ("title", "content", "tags")))), normal(F.lit(query)))


#: Pages of a whole table that end before this row are found by a top-k in each task, deeper ones by ranges of the order.
DEEP = 10_000
#: Pieces that a group is counted and ranked in first, so that a hot group is not one task's.
PIECES = 16


def page(matches: DataFrame, by: list[str], order: list[Column], index: int = 0, limit: int = PAGE) -> DataFrame:
    """The page's rows with ``total`` and ``pos``; a group with matches but none on the page gives one row with a null pos.

    Matches are read once: pieces of a group are counted and cut to the page's end, then the pieces meet, so a group's last task gets
    at most a page's end of rows for each piece. Without groups, a page is a top-k, or, where it lies deep, a range of
    row numbers that no task holds whole; the total is one row more. Columns named total or pos are replaced; rows that tie in ``order`` have no fixed place.
    """
    index, limit = max(0, index), min(MOST, max(1, limit))
    matches = matches.drop(*({"total", "pos"} - set(by)))
    first, last = index * limit + 1, (index + 1) * limit
    if not by:
        total = matches.agg(F.count("*").alias("total"))
        if last <= DEEP:
            few = matches.orderBy(*order).limit(last)  # top-k in each task, then one merge
            on_page = few.withColumn("pos", F.row_number().over(W.orderBy(*order))).where(F.col("pos") >= first)
        else:
            on_page = ordering.rows_at(matches, order, first - 1, last, "pos").withColumn("pos", (F.col("pos") + 1).cast("int"))
        return F.broadcast(total).join(on_page, F.lit(True), "left")  # one row of total
    piece, own, all_ = ordering.free("_piece", matches.columns), ordering.free("_own", matches.columns), W.partitionBy(*by)
    dealt = matches.withColumn(piece, F.pmod(F.xxhash64(*(c for c, kind in matches.dtypes if "map<" not in kind and "variant" not in kind)), F.lit(PIECES)))
    dealt = dealt.withColumn("pos", F.row_number().over(W.partitionBy(*by, piece).orderBy(*order))).withColumn(own, F.count("*").over(W.partitionBy(*by, piece)))
    few = dealt.where(F.col("pos") <= last).withColumn(own, F.when(F.col("pos") == 1, F.col(own)))
    met = few.withColumn("total", F.sum(own).over(all_)).withColumn("pos", F.row_number().over(all_.orderBy(*order)))
    here = F.col("pos").between(first, last)
    met = met.where(here | (F.col("pos") == 1) & (F.col("total") < first))
    return met.select(*by, "total", *(F.when(here, F.col(c)).alias(c) for c in matches.columns if c not in by), F.when(here, F.col("pos")).alias("pos"))


def envelope(paged: DataFrame, by: list[str], key: Column, item: Column) -> DataFrame:
    """{"total": n, key: [records of the page, in order]} as JSON, one row for each group."""
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", item.alias("item"))))), lambda s: s["item"])
    got = paged.groupBy(*by, "total").agg(own.alias("items"), F.first(key).alias("k"))
    return got.select(*by, F.concat(F.lit('{"total":'), F.col("total").cast("string"), F.lit(',"'), F.col("k"), F.lit('":'), F.to_json("items"), F.lit("}")).alias("response"))


def look_up(rows: DataFrame, by: list[str], wanted: Column, order: list[Column]) -> DataFrame:
    """The first record of each group that the condition holds for."""
    return rows.where(wanted).withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def call_error(name: Column, known: Column, has_schema_args: Column, credentials_ok: Column, found: Column) -> Column:
    """What is wrong with a call, in the order in which it is checked; null if nothing is."""
    return F.when(name.isNull() | ~known, "unknown tool").when(has_schema_args, "schema given as argument").when(~credentials_ok, "bad credentials").when(~found, "not found")


def gate(app: Column, logged_in: Column, exempt: Column) -> Column:
    """401 for an app that needs a login and has none."""
    return F.when(~exempt & ~F.array_contains(logged_in, app), 401)
