"""Chats as arrays of messages: build, check, split, merge, migrate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


def gather(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row for each chat: its messages in order."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(own, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def valid(messages: Column) -> Column:
    """Not empty, and each message has a role and a content."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))


def prune(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def prompt_and_reference(chats: DataFrame) -> DataFrame:
    """The last message, of any role, is the reference; the others are the prompt. Fewer than two messages: no row."""
    m = F.col("messages")
    return chats.where(F.size(m) >= 2).withColumns({"prompt": F.slice(m, 1, F.size(m) - 1), "reference": F.element_at(m, -1)["content"]})


def merge_system(messages: Column, between: str = "\n\n") -> Column:
    """A leading system message goes into the first user message; without a user message its text is lost."""
    system = F.get(messages, F.lit(0))
    rest = F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))
    first_user = F.array_position(F.transform(rest, lambda m: m["role"]), "user")
    merged = F.transform(rest, lambda m, i: F.when(i + 1 == first_user, F.struct(m["role"].alias("role"), F.concat(system["content"], F.lit(between), m["content"]).alias("content"))).otherwise(m))
    return F.when((F.size(messages) > 0) & (system["role"] == "system"), merged).otherwise(messages)


def with_observation(observation: Column, admissible: Column) -> Column:
    """The user turn: an observation and the commands that can be given."""
    return F.concat(F.lit("Observation:\n"), observation, F.lit("\n\nAdmissible commands:\n"), F.array_join(F.transform(admissible, lambda a: F.concat(F.lit("- "), a)), "\n"))


def few_shot(system: Column, examples: Column, question: Column) -> Column:
    """system, example turns, question."""
    def one(role: str, text: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))

    return F.concat(one("system", system), examples, one("user", question))


def for_model(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"].isin("user", "assistant", "tool"))


def rename_all(text: Column, names: list[tuple[str, str]]) -> Column:
    """Each old name replaced by its new one, in the order given."""
    for old, new in names:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def swap_first_block(text: Column, begin: str, end: str, new: Column) -> Column:
    """The first ``begin ... end`` replaced; a text without one stays as it is."""
    a = F.instr(text, F.lit(begin))
    inner = F.substr(text, a + len(begin))
    b = F.instr(inner, F.lit(end))
    return F.when((a > 0) & (b > 0), F.concat(F.substr(text, F.lit(1), a - 1 + len(begin)), new, F.substr(inner, b))).otherwise(text)


def replace_section(text: Column, title: str, before: str, new: Column) -> Column:
    """The section ``title`` up to the next heading replaced; where there is none, ``new`` goes before ``before``."""
    a = F.instr(text, F.lit(title))
    rest = F.substr(text, a + len(title))
    nxt = F.instr(rest, F.lit("\n## "))
    tail = F.when(nxt > 0, F.substr(rest, nxt)).otherwise(F.lit(""))
    at = F.instr(text, F.lit(before))
    inserted = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(title), F.lit("\n"), new, F.lit("\n"), F.substr(text, at))).otherwise(text)
    return F.when(a > 0, F.concat(F.substr(text, F.lit(1), a - 1), F.lit(title), F.lit("\n"), new, tail)).otherwise(inserted)


def migrate(messages: Column, names: list[tuple[str, str]]) -> Column:
    """Tool names renamed in the messages of every role but user; the other parts of a message stay."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] != "user", rename_all(m["content"], names)).otherwise(m["content"]).alias("content")))


def residual_names(chats: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """old_name, n: how many messages still hold an old name; no row for names that are gone."""
    old = F.explode(F.array(*(F.lit(o) for o, _ in names))).alias("old_name")
    return chats.select(F.explode("messages").alias("m")).select("m.content", old).where(F.contains("content", "old_name")).groupBy("old_name").agg(F.count("*").alias("n"))
