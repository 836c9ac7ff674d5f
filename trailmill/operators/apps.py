"""Calls of app tools: what a prompt lets them log in with, what they answer with, and what is wrong with them.

Everything comes from texts: a system prompt with credentials and record sections, and calls as a name with arguments in JSON. Null texts
hold nothing: no credentials, no arguments. Columns that are added replace columns of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.jsonx import has_placeholder_argument
from trailmill.functions.text import let
from trailmill.operators import ordering

#: The section of a prompt that each tool reads, and the key that its records come back under.
SECTION_OF_TOOL = {
    "spotify__show_song_library": "songs",
    "spotify__show_liked_songs": "songs",
    "spotify__search_songs": "songs",
    "spotify__show_album_library": "albums",
    "spotify__show_album": "albums",
    "spotify__show_playlist_library": "playlists",
    "spotify__show_playlist": "playlists",
    "spotify__show_recommendations": "songs",
    "spotify__show_following_artists": "following_artists",
    "spotify__show_artist": "artists",
    "venmo__show_transactions": "transactions",
    "venmo__show_received_payment_requests": "payment_requests",
    "venmo__show_sent_payment_requests": "payment_requests",
    "venmo__show_social_feed": "transactions",
    "venmo__search_friends": "venmo_friends",
    "file_system__show_directory": "directories",
    "file_system__show_file": "files",
    "simple_note__search_notes": "notes",
    "simple_note__show_note": "notes",
}
KEY_OF_SECTION = {
    "songs": "songs",
    "albums": "albums",
    "playlists": "playlists",
    "artists": "artists",
    "following_artists": "artists",
    "transactions": "transactions",
    "payment_requests": "payment_requests",
    "venmo_friends": "friends",
    "directories": "entries",
    "files": "files",
    "notes": "notes",
}
#: Tools that answer with one record or an error, and how a login's tool is named.
ONE_RECORD = ["spotify__show_album", "spotify__show_playlist", "spotify__show_artist", "simple_note__show_note", "file_system__show_file"]
LOGIN = "__login"
#: Rows of a dimension that may be sent to every task; a larger one is joined by a shuffle.
SENT = 10_000


def app_of(tool: Column) -> Column:
    """What stands before the first ``__``; the whole name where there is none."""
    return F.substring_index(tool, "__", 1)


def api_of(tool: Column) -> Column:
    """What stands after the first ``__``; the whole name where there is none."""
    return F.regexp_replace(tool, r"(?s)\A(?:(?!__).)*__", "")


def last_wins(pairs: Column) -> Column:
    """A map from an array of struct(key, value) in which the last of equal keys counts, whatever the session does about duplicates."""

    def kept(all_: Column) -> Column:
        return F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))

    return F.map_from_entries(let(pairs, kept))


def credentials_listed(prompt: Column) -> Column:
    """All lines ``- app: username=..., password=...`` of a prompt, in order: array of struct(app, username, password)."""
    line = r"(?U)- (\w+): username=([^,]+), password=(\S+)"
    apps, names, words = (F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(line), F.lit(k)) for k in (1, 2, 3))
    return F.zip_with(F.zip_with(apps, names, lambda a, n: F.struct(a.alias("app"), n.alias("username"))), words, lambda p, w: F.struct(p["app"].alias("app"), p["username"].alias("username"), w.alias("password")))


def credentials(prompt: Column) -> Column:
    """map app -> struct(username, password); of two lines of an app the last counts."""
    return last_wins(F.transform(credentials_listed(prompt), lambda c: F.struct(c["app"].alias("key"), F.struct(c["username"].alias("username"), c["password"].alias("password")).alias("value"))))


def argument(arguments: Column, name: str) -> Column:
    """A text argument; null where it is missing or no text."""
    return F.try_variant_get(F.try_parse_json(arguments), f"$.{name}", "string")


def login_accepted(tool: Column, arguments: Column, known: Column) -> Column:
    """Whether a call may pass for its credentials (``known``: the map of ``credentials``): every call but a login, a login of an app that the prompt doesn't name, or one with both right."""
    own = F.try_element_at(known, app_of(tool))
    right = argument(arguments, "username").eqNullSafe(own["username"]) & argument(arguments, "password").eqNullSafe(own["password"])
    return ~F.endswith(tool, F.lit(LOGIN)) | own.isNull() | right


def with_dimension(rows: DataFrame, key: str, dimension: DataFrame, value: str, default: str | None, name: str, sent: int = SENT) -> DataFrame:
    """Adds ``name``: ``value`` of the dimension's row with an equal ``key`` (unique there), else ``default``.

    The dimension is counted up to ``sent`` rows: so few go to every task, more are joined by a shuffle whose hot keys Spark splits. Both give the same rows.
    """
    theirs, given = ordering.free("_key", rows.columns), ordering.free("_value", rows.columns)
    small = dimension.select(F.col(key).alias(theirs), F.col(value).alias(given))
    few = small.limit(sent + 1).count() <= sent
    joined = rows.join(F.broadcast(small) if few else small, F.col(key) == F.col(theirs), "left")
    return joined.withColumn(name, F.coalesce(given, F.lit(default))).drop(theirs, given)


def dimension(spark, values: dict[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame([*values.items()], f"{key} string, {value} string")


def with_return_key(calls: DataFrame, tool: str = "tool", default: str = "data", sent: int = SENT) -> DataFrame:
    """Adds section (null: the tool reads none) and return_key (``default`` where nothing is known)."""
    spark = calls.sparkSession
    got = with_dimension(calls, tool, dimension(spark, SECTION_OF_TOOL, tool, "_to"), "_to", None, "section", sent)
    return with_dimension(got, "section", dimension(spark, KEY_OF_SECTION, "section", "_to"), "_to", default, "return_key", sent)


def in_catalogue(rows: DataFrame, key: str, catalogue: DataFrame, name: str, sent: int = SENT) -> DataFrame:
    """Adds ``name``: whether ``key`` is in the catalogue (a column of that name; repeats don't matter)."""
    known = catalogue.select(F.col(key), F.lit("y").alias("_in")).where(F.col(key).isNotNull()).distinct()
    return with_dimension(rows, key, known, "_in", None, name, sent).withColumn(name, F.col(name).isNotNull())


def with_error(calls: DataFrame, catalogue: DataFrame, tool: str = "tool", arguments: str = "arguments", prompt: str = "prompt", found: Column | None = None) -> DataFrame:
    """Adds ``error``, the first thing wrong with a call, or null: an unknown tool, schema in place of a value, wrong credentials, a record that is not there.

    ``found``: whether a call of ONE_RECORD finds its record (it is not asked for other tools); none: it does.
    """
    known = in_catalogue(calls.drop("error"), tool, catalogue, "_known")
    missing = F.col(tool).isin(ONE_RECORD) & ~F.coalesce(found, F.lit(False)) if found is not None else F.lit(False)
    error = (
        F.when(~F.col("_known"), F.concat(F.lit("Unknown tool: "), F.coalesce(tool, F.lit(""))))
        .when(has_placeholder_argument(F.col(arguments)), "Invalid argument values: schema/type dictionaries are not runtime values")
        .when(~login_accepted(F.col(tool), F.col(arguments), credentials(F.col(prompt))), "Invalid username or password")
        .when(missing, "Record not found")
    )
    return known.withColumn("error", error).drop("_known")


def signatures(tools: DataFrame) -> DataFrame:
    """tool, signature: ``tool(first, second)`` of tool, parameter, place (null parameter: none); a row for each tool."""
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("parameter").isNotNull(), F.struct("place", "parameter")))), lambda p: p["parameter"])
    own = tools.groupBy("tool").agg(named.alias("names"))
    return own.select("tool", F.concat("tool", F.lit("("), F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise("no parameters"), F.lit(")")).alias("signature"))
