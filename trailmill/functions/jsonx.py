"""JSON with Python's meaning: duplicate keys (the last wins), 1.0 against 1, NaN. Arrow UDFs, small helpers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical(text: str | None, spaced: bool) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(", ", ": ") if spaced else (",", ":"))
    except (ValueError, RecursionError):
        return text.strip()


def canonical(text: Column, spaced: bool = False) -> Column:
    """Sorted keys, fixed separators; a text that is not JSON is only stripped; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _canonical(x, spaced))

    return F.when(may_be_json(text), run(F.when(may_be_json(text), text))).otherwise(F.regexp_replace(text, PYTHON_BLANK, ""))


#: White space at both ends as Python strips it: Unicode's, and four separators more.
PYTHON_BLANK = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def may_be_json(text: Column) -> Column:
    """Whether a text begins as JSON may; any other one need not leave the JVM (it goes to Python as null)."""
    return F.coalesce(text.rlike(r'\A[ \t\n\r]*[\[{"\-0-9tfnNI]'), F.lit(False))


def semantic_equal(a: Column | str, b: Column | str) -> Column:
    """Both parse and are equal as Python values (1 == 1.0 == true); else equal as texts. Null is no text: false."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = may_be_json(a) & may_be_json(b)
    return F.when(both, _semantic_equal(F.when(both, a), F.when(both, b))).otherwise(F.coalesce(a == b, F.lit(False)))


@F.pandas_udf(T.BooleanType())
def _semantic_equal(a: pd.Series, b: pd.Series) -> pd.Series:

    def same(x, y) -> bool:
        if x is None or y is None:
            return False
        try:
            return bool(json.loads(x) == json.loads(y))
        except (ValueError, RecursionError):
            return x == y

    return pd.Series([same(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(T.StringType())
def output_fields(text: pd.Series) -> pd.Series:
    """Of a JSON object only `output` and `exception`; any other text, and an object without both, unchanged."""

    def cut(x):
        try:
            got = json.loads(x)
        except (ValueError, TypeError, RecursionError):
            return x
        kept = {k: got[k] for k in ("output", "exception") if k in got} if isinstance(got, dict) else {}
        return json.dumps(kept, sort_keys=True, ensure_ascii=False, separators=(",", ":")) if kept else x

    return text.map(cut)


#: What stands around a call in a model's text, and the notation of a call with keyword arguments.
NOISE = re.compile(r"```(?:json)?|<\|/?tool\|>")
KEYWORD_CALL = re.compile(r"(?:<\|tool_call_start\|>\s*)?\[\s*(\w+)\((.*?)\)\s*\]", re.DOTALL)
KEYWORD = re.compile(r"(\w+)\s*=\s*(?:\"([^\"]*)\"|(-?\d+))")
TAGGED = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.DOTALL)
#: Names under which a call's arguments stand, by notation: the first that is there counts.
BY_AGENT, BY_DEMO = ("arguments", "parameters"), ("parameters", "arguments")

MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)
OPENS = re.compile(r'\{\s*(?:"(?:[^"\\]|\\.)*"\s*:|\})|\[\s*[\[{"\d\-tfn\]]', re.DOTALL)
CLOSES = {"]": "[", "}": "{"}


def balanced(text: str) -> list[tuple[int, int]]:
    """Where each bracketed part of a text begins and ends, in the order of their beginnings, parts inside others too; one pass.

    A bracket counts where what follows could be JSON, so ``[1]`` in a sentence does and ``[sic]`` doesn't; brackets inside of strings don't count, and quotes
    do only inside of brackets. What is opened and never closed is left out.
    """
    found, open_, at = [], [], 0
    while m := MARK.search(text, at):
        c = m[0]
        if c[0] == '"':
            at = m.end() if open_ else m.start() + 1
            continue
        at = m.end()
        if c in "[{":
            if OPENS.match(text, m.start()):
                open_.append((c, m.start()))
        elif any(o == CLOSES[c] for o, _ in open_):
            while open_[-1][0] != CLOSES[c]:
                open_.pop()
            found.append((open_.pop()[1], m.end()))
    return sorted(found)


def _loads(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _named(got, names: tuple[str, ...]) -> tuple[str, dict] | None:
    """(name, arguments) of a parsed call, or of the first of a list; arguments that are no object count as none."""
    got = got[0] if isinstance(got, list) and got else got
    if not isinstance(got, dict):
        return None
    args = next((got[n] for n in names if n in got), {})
    args = _loads(args) if isinstance(args, str) else args
    return str(got.get("name", "")), args if isinstance(args, dict) else {}


def tool_call_parts(text: str | None) -> tuple[str | None, dict]:
    """(name, arguments) of a call in an agent's text, wherever it stands: with keyword arguments, else tagged, else the first array of calls, else the first object with a name."""
    text = NOISE.sub("", text or "").strip()
    if m := KEYWORD_CALL.search(text):
        return m[1], {k: s if not n else int(n) for k, s, n in KEYWORD.findall(m[2])}
    if m := TAGGED.search(text):
        return _named(_loads(m[1]), BY_AGENT) or (None, {})
    parts, end = [], 0
    for a, b in balanced(text) if '"name"' in text else ():
        if a >= end and '"name"' in text[a:b] and (got := _loads(text[a:b])) is not None:
            parts.append(got)
            end = b  # what lies inside of a parsed part is not looked at again
    calls = [p for p in parts if isinstance(p, list) and p and isinstance(p[0], dict) and "name" in p[0]] + [p for p in parts if isinstance(p, dict) and "name" in p]
    return _named(calls[0], BY_AGENT) if calls else (None, {})


def _tool_call(text: str | None) -> tuple[str | None, str | None]:
    name, args = tool_call_parts(text)
    return name, None if name is None else json.dumps(args, sort_keys=True)


def _demo_call(text: str | None) -> tuple[str | None, str | None]:
    """The same of a demonstration's text: JSON as a whole, else the first name and flat arguments that can be found; ``parameters`` come before ``arguments``."""
    text = text or ""
    got = _loads(text.strip())
    got = got[0] if isinstance(got, list) and got else got
    if isinstance(got, dict) and "name" in got:
        name, args = _named(got, BY_DEMO)
        return name, json.dumps(args, sort_keys=True)
    if not (m := re.search(r'"name"\s*:\s*"([^"]+)"', text)):
        return None, "{}"
    args = re.search(r'"(?:parameters|arguments)"\s*:\s*(\{[^}]*\})', text, re.DOTALL)
    args = _loads(args[1]) if args else None
    return m[1], json.dumps(args if isinstance(args, dict) else {}, sort_keys=True)


CALLED = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])


@F.pandas_udf(CALLED)
def tool_call(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_tool_call(x) for x in text], columns=["name", "arguments"])


@F.pandas_udf(CALLED)
def demo_call(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_demo_call(x) for x in text], columns=["name", "arguments"])


# Objects of unknown keys, in the JVM


def members(text: Column) -> Column:
    """The members of a JSON object as a map of variants, in the text's order; null for any other text."""
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, "map<string,variant>"))


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A\w+", 0)


def has_placeholder_argument(arguments: Column) -> Column:
    """Whether any argument is a piece of schema in place of a value: an object with ``type``, or a text that holds one. False where there is no object."""

    def piece(value: Column) -> Column:
        kind = kind_of(value)
        said = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        typed = (kind == "OBJECT") & F.try_variant_get(value, "$.type", "variant").isNotNull()
        return typed | F.coalesce(F.contains(said, F.lit("{'type'")) | F.contains(said, F.lit('{"type"')), F.lit(False))

    return F.coalesce(F.exists(F.map_values(members(arguments)), piece), F.lit(False))


def first_list(text: Column) -> Column:
    """struct(key, items array<variant>) of the first member, in the text's order, that is a list and not empty; null where there is none."""
    lists = F.filter(F.map_entries(members(text)), lambda e: (kind_of(e["value"]) == "ARRAY") & (F.size(F.try_variant_get(e["value"], "$", "array<variant>")) > 0))
    return F.get(F.transform(F.slice(lists, 1, 1), lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "array<variant>").alias("items"))), F.lit(0))
