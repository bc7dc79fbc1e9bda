"""Text functions: vocabularies, prompts, answers, JSON repair."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def labels_of(text: Column) -> Column:
    """Labels of a vocabulary line: split at commas, slashes and "_or_"; underscores are spaces; lower case, trimmed, none empty."""
    plain = F.lower(F.replace(F.regexp_replace(text, "_or_|/", ","), F.lit("_"), F.lit(" ")))
    return F.filter(F.transform(F.split(plain, ","), lambda w: F.trim(w)), lambda w: w != "")


def vocabulary_entry(line: Column) -> Column:
    """What follows the first colon of "id:name,synonym"."""
    return F.regexp_extract(line, "^[^:]*:(.*)$", 1)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Named signs of HTML and what they stand for; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def span_means(df: DataFrame, key: str, values: str, size: int, apart: int) -> DataFrame:
    """(key, class, score): the mean of each class's stretch of ``size`` values, ``apart`` values between two stretches."""
    placed = df.select(key, F.posexplode(values).alias("pos_", "v_"))
    own = F.floor(F.col("pos_") / (size + apart)).cast("int").alias("class")
    return placed.filter(F.col("pos_") % (size + apart) < size).groupBy(key, own).agg(F.avg(F.col("v_").cast("double")).alias("score"))


def answer_probability(tokens: Column, logs: Column, begin: str, end: str) -> Column:
    """The product of the probabilities from the first ``begin`` up to the next ``end``, which counts no more; null without a beginning."""
    first = F.array_position(tokens, begin)
    rest = F.slice(tokens, F.greatest(first, F.lit(1)).cast("int"), F.size(tokens))
    last = F.array_position(rest, end)
    some = F.when(last > 0, last - 1).otherwise(F.size(rest)).cast("int")
    total = F.aggregate(F.slice(logs, F.greatest(first, F.lit(1)).cast("int"), some), F.lit(0.0), lambda s, v: s + v)
    return F.when(first > 0, F.exp(total))


def filled(template: Column, **values: Column) -> Column:
    """The template with each {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def numbered(items: Column) -> Column:
    """"1. first", "2. second", one to a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def answer_json(text: Column) -> Column:
    """The JSON object of an answer, fenced or bare, on one line; empty if there is none."""
    plain = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("json"), F.lit(""))
    fenced = F.regexp_extract(plain, r"```\s*(\{.*\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(plain, r"(\{.*\})", 1))


def parsed_answer(text: Column) -> Column:
    """struct(tasks, scores): tasks split at semicolons, trimmed, none empty; confidences split at commas, 0 where not a number; nulls for what is not there."""
    parsed = F.from_json(answer_json(text), "tasks string, confidence string")
    tasks = F.filter(F.transform(F.split(parsed.tasks, ";"), lambda t: F.trim(t)), lambda t: t != "")
    scores = F.transform(F.split(parsed.confidence, ","), lambda c: F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0)))
    return F.struct(tasks.alias("tasks"), scores.alias("scores"))


def only_state(text: Column, states: Column) -> Column:
    """The one state that the text mentions; null if none or several."""
    found = F.filter(states, lambda s: F.contains(F.lower(text), F.lower(s)))
    return F.when(F.size(found) == 1, found[0])


def padded_labels(labels: Column, n: int) -> Column:
    """Exactly n labels, with "" for those missing."""
    return F.slice(F.concat(F.coalesce(labels, F.array().cast("array<string>")), F.array_repeat(F.lit(""), n)), 1, n)


def repaired(text: str | None) -> str | None:
    """JSON cut off at its end: open strings and brackets are closed, then characters are dropped from the end until it parses; None if nothing does.

    The text is read once, noting at each place the string that is open and what would close the brackets. What fails
    inside a string fails for all of it, and what fails at a place fails for all ends beyond, so that few ends are tried.
    """
    if text is None:
        return None
    text = re.sub(r"[\x00-\x1f]", " ", text.strip().strip("`").removeprefix("json").strip())
    opened: list[int] = []  # for each end: where the open string starts, -1 outside of strings
    depth: list[int] = []  # for each end: the node of the stack's top
    above, closer = [-1], [""]  # the stack as a tree: node's parent and the bracket that closes it
    top, start, escaped = 0, -1, False
    for k, c in enumerate(text):
        if start >= 0:
            if c == '"' and not escaped:
                start = -1
            escaped = c == "\\" and not escaped
        elif c == '"':
            start, escaped = k, False
        elif c in "{[":
            above.append(top)
            closer.append("}" if c == "{" else "]")
            top = len(above) - 1
        elif c in "}]" and closer[top] == c:
            top = above[top]
        opened.append(start)
        depth.append(top)
    end = len(text)
    while end > 0:
        node, closing = depth[end - 1], ""
        while node:
            closing, node = closing + closer[node], above[node]
        inside = opened[end - 1] >= 0
        whole = text[:end] + '"' * inside + closing
        try:
            json.loads(whole)
            return whole
        except json.JSONDecodeError as error:
            cut = text[:end].endswith("\\") and inside  # an escape that was cut off: one character less may do
            end = end - 1 if cut else min(opened[end - 1] if inside else end - 1, max(error.pos, 0))
    return None


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repaired)


def best_match(word: Column, candidates: Column) -> Column:
    """The candidate equal to the word, or the one with the fewest edits (the first by name on ties)."""
    scored = F.transform(candidates, lambda c: F.struct(F.levenshtein(c, word).alias("d"), c.alias("c")))
    return F.when(F.array_contains(candidates, word), word).otherwise(F.array_min(scored)["c"])
