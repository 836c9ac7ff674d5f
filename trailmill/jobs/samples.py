"""Sampling jobs: dedupe, caps, shards, batches, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill import shared
from trailmill.jobs.common import table
from trailmill.jobs.trajectories import flags_sql
from trailmill.operators import ordering, sampling, scoring
from trailmill.shared import new_path
from trailmill.streaming import kills


def sample_keep_first(spark, sf_dir):
    """The first document of each text, and a union with the benchmark's texts."""
    docs = scoring.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], [F.col("doc_id")])
    both = docs.select(F.lit("documents").alias("part"), F.col("doc_id").alias("id")).unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("part"), F.col("item_id").alias("id")))
    return both.select("part", "id")


def sample_stratified(spark, sf_dir):
    return sampling.stratified_cap(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 200, 500).select("doc_id", "lang")


def sample_shards(spark, sf_dir):
    return sampling.shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 8).groupBy("shard").agg(F.count("*").alias("n"), F.sum("doc_id").alias("checksum"))


def sample_round_robin(spark, sf_dir):
    rows = sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 4)
    return rows.groupBy("source", "shard").agg(F.count("*").alias("n"), F.sum("doc_id").alias("checksum"))


def sample_length_batches(spark, sf_dir):
    rows = sampling.length_batches(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", F.col("n_chars"), ["doc_id"], 16)
    return rows.groupBy("source", "batch").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


def sample_kept_order(spark, sf_dir):
    """Documents with a text of at least two words, in the order of their ids: the place among those kept, and whether they pass a budget of 2,000 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    kept = sampling.kept_in_order(rows, F.contains(F.trim("text"), F.lit(" ")), [F.col("doc_id")], F.length("text"), 2000)
    return kept.select("index", "doc_id", "overlong")


def sample_ordered_files(spark, sf_dir):
    """Documents written as files that are in order one after the other, and read back: the place in the concatenation."""
    path = new_path(spark, "in-order")
    ordering.write_in_order(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], path)
    return ordering.read_in_order(spark, path, "place")


def sample_first(spark, sf_dir):
    """A prefix of a shuffled order, and the whole table where the limit is zero or less."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    part = lambda n, name: sampling.prefix(docs, [sampling.shuffle_key("doc_id"), F.col("doc_id")], n).select(F.lit(name).alias("part"), "doc_id")
    return part(25, "25").unionByName(part(0, "all"))


def sample_splits(spark, sf_dir):
    """A split by text, so that copies stay together."""
    rows = sampling.split(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("g")), F.col("g"))
    return rows.select("doc_id", "split")


def sample_split_leaks(spark, sf_dir):
    """Texts in more than one split: by text there are none, by document there are some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("g"))
    good, bad = sampling.split(docs, F.col("g")), sampling.split(docs, F.col("doc_id").cast("string"))
    return sampling.leaks(good, "g").select(F.lit("by text").alias("rule"), "g", "n_splits").unionByName(sampling.leaks(bad, "g").select(F.lit("by document").alias("rule"), "g", "n_splits"))


def sample_disjoint(spark, sf_dir):
    """Documents outside of the train split (a split by document) whose text no document of the train split has."""
    docs = sampling.split(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("g")), F.col("doc_id").cast("string"))
    return sampling.disjoint(docs.where("split <> 'train'"), docs.where("split = 'train'"), ["g"]).select("doc_id")


#: Files that the event streams arrive in, a micro-batch each.
ARRIVALS = 5


def _arriving(spark, sf_dir):
    """The events as a stream of ARRIVALS micro-batches in the order of time: each is written after the one before, and taken alone."""
    path = new_path(spark, "arrivals")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    placed = shared.stored(ordering.numbered(events, [F.col("ts"), F.col("event_id")], "place"), "placed")
    n = placed.count()
    for k in range(ARRIVALS):
        placed.where((F.col("place") >= k * n // ARRIVALS) & (F.col("place") < (k + 1) * n // ARRIVALS)).drop("place").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_kills(spark, sf_dir):
    """An extension: the first violation of each trajectory, from a stream of several micro-batches with keyed state."""
    rows = _arriving(spark, sf_dir)
    rows = rows.select(F.col("user_id").cast("string").alias("rid"), "ts", "event_id", F.col("event_type").alias("action"), (F.col("event_type") == "error").alias("nothing"))
    return _drained(spark, kills.kills(rows), "append")


def stream_daily(spark, sf_dir):
    """An extension: events by type in day windows with a watermark, over several micro-batches."""
    got = _drained(spark, kills.windowed_rates(_arriving(spark, sf_dir)), "append")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


def _drained(spark, frame, mode: str):
    """The stream's output so far, as a table in the shared folder: files, so that no result passes through the driver."""
    out = new_path(spark, "stream")
    frame.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


QUERIES = {f.__name__: f for f in (sample_keep_first, sample_stratified, sample_shards, sample_round_robin, sample_length_batches, sample_kept_order, sample_ordered_files, sample_first, sample_splits, sample_split_leaks, sample_disjoint, stream_kills, stream_daily)}

KEY = "md5('{}:' || {})"
UNIT = "CAST(('0x' || left(md5('{}:' || {}), 8)) AS BIGINT)"

ORACLE_SQL = {
    "stream_kills": f"""WITH {flags_sql()}, k AS (SELECT user_id, n, CASE WHEN aaa OR abab THEN 'loop' WHEN streak >= 4 THEN 'stuck' END AS kill FROM f)
SELECT CAST(user_id AS VARCHAR) AS rid, min(n) AS turn, min_by(kill, n) AS kill FROM k WHERE kill IS NOT NULL GROUP BY user_id""",
    "stream_daily": """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
    "sample_keep_first": "SELECT 'documents' AS part, min(doc_id) AS id FROM documents GROUP BY text UNION ALL SELECT 'benchmark', item_id FROM benchmark",
    "sample_stratified": f"""
WITH r AS (SELECT doc_id, lang, {KEY.format(7, "doc_id")} AS k FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS i FROM r)
SELECT doc_id, lang FROM n WHERE i <= 200 ORDER BY k, doc_id LIMIT 500""",
    "sample_shards": f"SELECT CAST({UNIT.format(7, 'doc_id')} % 8 AS INT) AS shard, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS checksum FROM documents GROUP BY 1",
    "sample_round_robin": """
WITH r AS (SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS INT) AS shard FROM documents) SELECT source, shard, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS checksum FROM r GROUP BY source, shard""",
    "sample_length_batches": """
WITH r AS (SELECT source, n_chars, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) / 16) AS BIGINT) AS batch FROM documents) SELECT source, batch, count(*) AS n, max(n_chars) AS longest FROM r GROUP BY source, batch""",
    "sample_kept_order": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index, doc_id, length(text) > 2000 AS overlong FROM documents WHERE contains(trim(text), ' ')",
    "sample_ordered_files": "SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents",
    "sample_first": f"SELECT '25' AS part, doc_id FROM (SELECT doc_id FROM documents ORDER BY {KEY.format(7, 'doc_id')}, doc_id LIMIT 25) UNION ALL SELECT 'all', doc_id FROM documents",
    "sample_splits": f"WITH u AS (SELECT doc_id, {UNIT.format(42, 'md5(text)')} / 4294967296.0::DOUBLE AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'test' ELSE 'eval' END AS split FROM u",
    "sample_split_leaks": f"""
WITH u AS (SELECT md5(text) AS g, {UNIT.format(42, "doc_id")} / 4294967296.0::DOUBLE AS u FROM documents), s AS (SELECT g, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'test' ELSE 'eval' END AS split FROM u)
SELECT 'by document' AS rule, g, count(DISTINCT split) AS n_splits FROM s GROUP BY g HAVING count(DISTINCT split) > 1""",
    "sample_disjoint": f"WITH u AS (SELECT doc_id, md5(text) AS g, {UNIT.format(42, "doc_id")} / 4294967296.0::DOUBLE AS u FROM documents) SELECT doc_id FROM u WHERE u >= 0.8 AND g NOT IN (SELECT g FROM u WHERE u < 0.8)",
}
