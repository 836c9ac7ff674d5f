"""Record-store jobs: orders and lines as text records in prompts, and as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.functions.text import record_field, safe_int
from trailmill.jobs.common import table
from trailmill.operators import records


def page_orders(spark, sf_dir):
    """Filter, count, then page 1 of size 20: the total counts all matches."""
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 1000))
    return records.page(rows.select("o_orderkey", "o_totalprice"), [], [F.desc("o_totalprice"), F.col("o_orderkey")], index=1, limit=50).select("total", F.col("pos").cast("long").alias("pos"), "o_orderkey", "o_totalprice")


def page_by_customer(spark, sf_dir):
    """The second page of five of each customer's orders; a customer whose page is empty keeps the total."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return records.page(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], index=1, limit=5).select("o_custkey", "total", F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("pos"), F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


def page_beyond_the_end(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return records.page(rows.select("o_orderkey"), [], [F.col("o_orderkey")], index=1_000_000, limit=20).select("total", F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("pos"), F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


def _prompts(spark, sf_dir):
    """A prompt for each order, with its lines as song records and one section more."""
    line = F.concat(
        F.lit("    - id: "), F.col("l_linenumber").cast("string"), F.lit(", title: Part "), F.col("l_partkey").cast("string"), F.lit(", part two, genre: "), F.when(F.col("l_returnflag") == "R", " Rock").otherwise("pop"),
        F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit(", play_count: "), F.col("l_quantity").cast("int").cast("string"))).otherwise(""), F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit(", release_date: "), F.date_format("l_shipdate", "yyyy-MM-dd"))).otherwise(""),
        F.lit(", liked: "), F.when(F.col("l_linestatus") == "O", "True").otherwise("False"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy(F.col("l_orderkey").alias("prompt_id")).agg(F.concat(F.lit("You know:\n  songs ("), F.count("*").cast("string"), F.lit(" total):\n"), body, F.lit("\n  albums (0 total):\n")).alias("prompt"))


def store_records(spark, sf_dir):
    """Records parsed back from the prompts, with typed fields; a comma inside a title stays."""
    rows = records.records(_prompts(spark, sf_dir), "songs").withColumn("m", records.to_map(F.col("record")))
    return rows.select("prompt_id", F.col("pos").cast("long").alias("pos"), F.col("m")["title"].alias("title"), records.typed(F.col("m")["play_count"])["number"].alias("play_count"), F.col("m")["release_date"].alias("release_date"), records.typed(F.col("m")["liked"])["flag"].alias("liked"))


def store_totals(spark, sf_dir):
    return _prompts(spark, sf_dir).select("prompt_id", records.section_total(F.col("prompt"), "songs").alias("songs"), records.section_total(F.col("prompt"), "albums").alias("albums"))


def store_search(spark, sf_dir):
    """Songs by genre, bounds and likes: a missing count rejects a song, a missing date doesn't."""
    rows = records.records(_prompts(spark, sf_dir), "songs")
    args = {"genre": "rock", "min_play_count": 10, "max_play_count": 40, "min_release_date": "1995-01-01", "liked": True}
    return rows.where(records.song_filter(F.col("record"), args)).select("prompt_id", safe_int(record_field(F.col("record"), "id")).alias("id"))


def store_search_pages(spark, sf_dir):
    """The answer to each prompt's search as a JSON envelope with total and page."""
    found = records.records(_prompts(spark, sf_dir), "songs").where(records.song_filter(F.col("record"), {"query": "rock"}))
    paged = records.page(found.withColumnRenamed("pos", "place"), ["prompt_id"], [F.col("place")], index=0, limit=2)
    return records.envelope(paged, ["prompt_id"], F.lit("songs"), F.struct(safe_int(record_field(F.col("record"), "id")).alias("id")))


def store_transactions(spark, sf_dir):
    """Orders as transaction records, filtered by amount and creation time."""
    text = F.concat(F.lit("id: "), F.col("o_orderkey").cast("string"), F.lit(", direction: "), F.when(F.col("o_orderkey") % 2 == 0, "sent").otherwise("Received"), F.lit(", amount: $"), F.format_string("%.2f", "o_totalprice"), F.lit(", created_at: "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    args = {"direction": "received", "min_amount": 2000.0, "max_amount": 90000.0, "min_created_at": "1995-01-01"}
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("record")).where(records.transaction_filter(F.col("record"), args)).select("o_orderkey")


def store_request_status(spark, sf_dir):
    text = F.concat(F.lit("id: 1, direction: sent"), F.when(F.col("o_orderstatus") == "F", ", approved_at: 2020").when(F.col("o_orderstatus") == "P", ", denied_at: 2020").otherwise(""))
    return table(spark, sf_dir, "orders").groupBy(records.request_status(text).alias("status")).agg(F.count("*").alias("n"))


def store_notes_and_folders(spark, sf_dir):
    note = F.concat(F.lit("id: 1, title: "), F.col("p_name"), F.lit(", content: "), F.col("p_type"), F.lit(", tags: "), F.col("p_brand"), F.lit(", owner: Brand#1"))
    entry = F.concat(F.lit("path: /home/"), F.col("p_brand"), F.when(F.col("p_size") > 25, ", tilde_path: ~/x").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", records.note_filter(note, "brand#1").alias("note"), records.directory_filter(entry, substring="brand#2", entry_type="directories").alias("folder"))


def store_look_up(spark, sf_dir):
    """The first line of each order that came back; orders without one give no row."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return records.look_up(rows, ["l_orderkey"], F.col("l_returnflag") == "R", [F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


def store_call_errors(spark, sf_dir):
    """Event rows as calls: what is wrong with each, in order of the checks, and the login gate."""
    e = table(spark, sf_dir, "events")
    k = safe_int(F.get_json_object("props", "$.k"), 0)
    error = records.call_error(F.col("event_type"), F.col("event_type") != "view", k % 7 == 0, k % 5 != 0, k % 3 != 0)
    gate = records.gate(F.col("event_type"), F.array(F.lit("click"), F.lit("signup")), k > 50)
    return e.groupBy(F.coalesce(error, F.lit("none")).alias("error"), F.coalesce(gate, F.lit(0)).cast("long").alias("status")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (page_orders, page_by_customer, page_beyond_the_end, store_records, store_totals, store_search, store_search_pages, store_transactions, store_request_status, store_notes_and_folders, store_look_up, store_call_errors)}

ORACLE_SQL = {
    "page_orders": """
WITH m AS (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000)
SELECT total, pos, o_orderkey, o_totalprice FROM m WHERE pos BETWEEN 21 AND 40""",
    "page_by_customer": """
WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders),
t AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey)
SELECT t.o_custkey, total, coalesce(pos, -1) AS pos, coalesce(o_orderkey, -1) AS o_orderkey FROM t LEFT JOIN m ON m.o_custkey = t.o_custkey AND pos BETWEEN 6 AND 10""",
    "page_beyond_the_end": "SELECT count(*) AS total, CAST(-1 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS o_orderkey FROM orders WHERE o_orderstatus = 'P'",
    "store_records": """
SELECT l_orderkey AS prompt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, 'Part ' || l_partkey || ', part two' AS title,
  CASE WHEN l_suppkey % 3 <> 0 THEN CAST(CAST(trunc(l_quantity) AS INT) AS DOUBLE) END AS play_count, CASE WHEN l_suppkey % 4 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS release_date, l_linestatus = 'O' AS liked FROM lineitem""",
    "store_totals": "SELECT l_orderkey AS prompt_id, count(*) AS songs, CAST(0 AS BIGINT) AS albums FROM lineitem GROUP BY l_orderkey",
    "store_search": """
SELECT l_orderkey AS prompt_id, CAST(l_linenumber AS BIGINT) AS id FROM lineitem
WHERE l_returnflag = 'R' AND l_suppkey % 3 <> 0 AND trunc(l_quantity) BETWEEN 10 AND 40 AND (l_suppkey % 4 = 0 OR strftime(l_shipdate, '%Y-%m-%d') >= '1995-01-01') AND l_linestatus = 'O'""",
    "store_search_pages": """
WITH m AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey AS prompt_id, '{"total":' || any_value(total) || ',"songs":[' || string_agg('{"id":' || l_linenumber || '}', ',' ORDER BY pos) || ']}' AS response FROM m WHERE pos <= 2 GROUP BY l_orderkey""",
    "store_transactions": "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 <> 0 AND round(o_totalprice, 2) BETWEEN 2000 AND 90000 AND strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01'",
    "store_request_status": "SELECT CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'denied' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "store_notes_and_folders": "SELECT p_partkey, contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brand#1') AS note, contains(lower(p_brand), 'brand#2') AND p_size > 25 AS folder FROM part",
    "store_look_up": "SELECT l_orderkey, min(l_linenumber) AS l_linenumber, min_by(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey",
    "store_call_errors": """
WITH e AS (SELECT event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)
SELECT CASE WHEN event_type = 'view' THEN 'unknown tool' WHEN k % 7 = 0 THEN 'schema given as argument' WHEN k % 5 = 0 THEN 'bad credentials' WHEN k % 3 = 0 THEN 'not found' ELSE 'none' END AS error,
  CAST(CASE WHEN k <= 50 AND event_type NOT IN ('click', 'signup') THEN 401 ELSE 0 END AS BIGINT) AS status, count(*) AS n FROM e GROUP BY 1, 2""",
}
