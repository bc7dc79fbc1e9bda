"""Removal of repeated runs of lines by winnowing, with DataFrame functions only.

A run of whole lines goes where it has at least ``min_words`` words and the same lines in the same order
occur earlier (by key, then text hash, then position). The first occurrence stays.

*Fingerprints.* From each line a window reaches forward over as many lines as are needed to hold
``min_words`` words. The smallest line hash of a window is selected, with its position, once for all windows
that select it. A repeated run holds a whole window at its start, with the same minimum in either place,
so no run of ``min_words`` words escapes (the guarantee of winnowing).
*Positions.* Fingerprints selected at one position only are done with; the others' positions are the matches
to extend.
*Extension.* From the lines around a shared position windows of ``min_words`` words reach both ways,
forward from a line and backward from a line; those that hold a shared position are compared as wholes (128 bits of all
their lines' hashes) with their first occurrence. The union of the repeated ones is the run's full extent: a line less
than ``min_words`` from the run's start lies in its first forward window, any other in the backward window that
ends with it.

``dedup_lines`` has whole lines as units, as its SQL does. ``dedup_passages`` has the pieces of lines, cut at places
that the words alone decide, so a passage inside longer lines holds the same pieces wherever it stands. Words are
stretches between single spaces: of a script without spaces a line is one word, and a run needs ``min_words`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, hot_aware_join, passing, text_hash

MIN_WORDS = 30
#: Where texts are cut into units, as regular expressions of Java: lines, without their line feeds; or pieces, which
#: together are the text. A piece ends with its line, or with a single space after a mark of a sentence's end or
#: after two characters that stand for a hash of the word: a vowel or digit, then one whose code leaves 4 modulo 8 or one of another script's.
LINES = "\n"
PIECES = r"(?<=\n)|(?:(?<=[.!?…。] )|(?<=[aeiou0-9][4<DLTdt¤¬´¼ÄÌÔÜäìôü] )|(?<=[Ͱ-ӿ][яйтος] ))(?! )"


def unit_lines(docs: DataFrame, document: Column, units: str = LINES) -> DataFrame:
    """(d, pos, h, g, w): document, position, two hashes and words of each line that is not blank.

    A line counts without the spaces around it; its words are its stretches between single spaces. Blank
    lines have no words and are passed over. Rows of the same document may repeat its lines.
    """
    lines = docs.select(document.alias("d"), F.posexplode(F.split("text", units)).alias("pos", "line"))
    lines = lines.select("d", "pos", F.trim(F.rtrim("line", F.lit("\n"))).alias("line")).filter("line <> ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.select("d", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("g"), words.cast("long").alias("w"))


def _placed(lines: DataFrame) -> DataFrame:
    """Adds the words up to each line (``upto``) and before it."""
    order = Window.partitionBy("d").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("upto", F.sum("w").over(order)).withColumn("before", F.col("upto") - F.col("w"))


def _forward(min_words: int) -> WindowSpec:
    return Window.partitionBy("d").orderBy("before").rangeBetween(0, min_words - 1)


def _backward(min_words: int) -> WindowSpec:
    return Window.partitionBy("d").orderBy("upto").rangeBetween(1 - min_words, 0)


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, pos, h): the selected minima, each position once."""
    # Rows that repeat a document fold before the shuffle: their equal positions are one.
    lines = lines.groupBy("d", "pos").agg(F.min("h").alias("h"), F.min("w").alias("w"))
    frame = _forward(min_words)
    seen = _placed(lines).select("d", F.min(F.struct("h", "pos")).over(frame).alias("least"), F.sum("w").over(frame).alias("words"))
    return seen.filter(F.col("words") >= min_words).select("d", "least.pos", "least.h").distinct()


def extensions(lines: DataFrame, hits: DataFrame, min_words: int) -> DataFrame:
    """(d, a, b, whole): the windows of lines a to b, both ways, that hold a position of ``hits``, with 128 bits of all their lines."""
    nothing = F.lit(None).cast("long")
    marks = hits.select("d", "pos", nothing.alias("h"), nothing.alias("g"), nothing.alias("w"), F.lit(1).alias("hit"))
    lines = lines.withColumn("hit", F.lit(0)).unionByName(marks).groupBy("d", "pos").agg(*(F.max(c).alias(c) for c in ("h", "g", "w", "hit")))
    whole = Window.partitionBy("d").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = _placed(lines.withColumn("some", F.max("hit").over(whole)).filter("some = 1"))
    for side, frame in (("f", _forward(min_words)), ("b", _backward(min_words))):
        lines = lines.withColumn(
            side,
            F.struct(
                F.min("pos").over(frame).alias("a"), F.max("pos").over(frame).alias("b"), F.max("hit").over(frame).alias("hit"),
                F.sum("w").over(frame).alias("words"), F.collect_list("h").over(frame).alias("h"), F.collect_list("g").over(frame).alias("g"),
            ),
        )
    windows = lines.select("d", F.explode(F.array("f", "b")).alias("x")).filter((F.col("x.words") >= min_words) & (F.col("x.hit") == 1))
    return windows.select("d", "x.a", "x.b", F.struct(F.xxhash64("x.h").alias("h"), F.xxhash64("x.g").alias("g")).alias("whole"))


def repeated_runs(lines: DataFrame, min_words: int, scratch: Scratch, keys: DataFrame | None = None) -> DataFrame:
    """(d, spans): for each document with repeated runs, the maximal spans of lines to delete in ascending order.

    Documents come in the order of ``keys`` (d, k), where given, then of d.
    """
    minima = scratch.keep(fingerprints(lines, min_words), "minima")
    shared = scratch.keep(minima.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    hits = scratch.keep(hot_aware_join(minima, shared, "h", "n", minima.count()).select("d", "pos"), "hits")
    covering = extensions(lines, hits, min_words)
    if keys is None:
        covering = covering.withColumn("k", F.lit(None).cast("long"))
    else:
        covering = covering.join(keys.select("d", "k").hint("merge"), "d")
    covering = scratch.keep(covering, "covering")
    place = F.struct("k", "d", "a")
    first = scratch.keep(covering.groupBy("whole").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "first")
    later = hot_aware_join(covering, first, "whole", "n", covering.count()).filter(~place.eqNullSafe(F.col("first")))
    # Overlapping and adjoining spans become one: gaps and islands over each document's own spans.
    document = Window.partitionBy("d")
    seen = F.max("b").over(document.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    spans = later.select("d", "a", "b").distinct().withColumn("new", F.when(F.col("a") <= seen + 1, 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("new").over(document.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("d", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _with_spans(docs: DataFrame, document: Column, runs: DataFrame) -> DataFrame:
    """(row, spans): each row with its document's spans of ``runs`` (d, n rows of the document, spans), null without."""
    held = docs.select(F.struct("*").alias("row"), document.alias("d"))
    return hot_aware_join(held, runs, "d", "n", docs.count(), "left", wide=True).select("row", "spans")


def dedup_lines(docs: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``, and n_lines and n_removed added.

    Every row stays: a document that is a later copy as a whole has empty text. A null text
    stays null with no lines; a text without a repeated run comes back byte for byte. Of texts
    under the same key (or null keys) the order is that of their hash; rows that repeat key and text are one
    document and share its result. Null keys come first. Columns n_lines and n_removed of the
    input are replaced; all others are carried along.
    """
    document = F.struct(F.col(key).alias("k"), *text_hash())
    last = Scratch(docs.sparkSession)
    with passing():
        runs = repeated_runs(unit_lines(docs, document), min_words, Scratch(docs.sparkSession))
        rows = docs.groupBy(document.alias("d")).agg(F.count("*").alias("n"))
        runs = last.keep(runs.join(rows.hint("merge"), "d"), "runs")
    joined = _with_spans(docs, document, runs)
    lines = F.split("row.text", "\n")
    left = F.filter(lines, lambda _, i: ~F.exists("spans", lambda s: (s.a <= i) & (i <= s.b)))
    joined = joined.withColumn("left", F.when(F.col("spans").isNotNull(), left))
    counted = F.coalesce(F.size(lines), F.lit(0))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(counted)
    n_removed = F.when(F.col("left").isNull(), 0).otherwise(counted - F.size("left"))
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    kept = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*kept, n_lines.cast("int").alias("n_lines"), n_removed.cast("int").alias("n_removed"))


def dedup_passages(docs: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of pieces of lines cut out of ``text``, and n_removed (pieces) added.

    Every row stays. Rows of one text all come back as the first of them does: which of them stay is not
    asked here. Of a passage the pieces that it holds whole are its extent; the rest of a piece at either end
    stays. A line feed stays where a run is cut from the middle of a line to its end. Null texts and null keys
    are as in ``dedup_lines``. A column n_removed of the input is replaced.
    """
    document = F.struct(*text_hash())
    last = Scratch(docs.sparkSession)
    with passing():
        scratch = Scratch(docs.sparkSession)
        texts = docs.filter("text is not null").groupBy(document.alias("d")).agg(F.count("*").alias("n"), F.min(F.struct(F.col(key).alias("k"))).alias("k"))
        texts = scratch.keep(texts, "texts")
        runs = repeated_runs(unit_lines(docs, document, PIECES), min_words, scratch, texts)
        runs = last.keep(runs.join(texts.select("d", "n").hint("merge"), "d"), "runs")
    joined = _with_spans(docs, document, runs)
    pieces = F.split("row.text", PIECES)
    feed = lambda p: F.endswith(p, F.lit("\n"))
    inside = lambda s, p, i: (s.b == i) & (s.a > 0) & feed(p) & ~feed(F.get(pieces, s.a - 1))
    gone = lambda p, i: F.when(F.exists("spans", lambda s: inside(s, p, i)), F.lit("\n")).otherwise(F.lit(""))
    left = F.transform(pieces, lambda p, i: F.when(F.exists("spans", lambda s: (s.a <= i) & (i <= s.b)), gone(p, i)).otherwise(p))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(left, ""))
    n = F.coalesce(F.aggregate("spans", F.lit(0), lambda x, s: x + (s.b - s.a + 1)), F.lit(0))
    kept = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_removed"]
    return joined.select(*kept, n.alias("n_removed"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, trim(line) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
worded AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS w FROM lines WHERE line <> ''),
placed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS upto, sum(w) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT - w AS before FROM worded),
windows AS (
  SELECT doc_id, min(pos) OVER f AS a, max(pos) OVER f AS b, string_agg(line, chr(10)) OVER f AS whole, sum(w) OVER f AS words FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER f AS a, max(pos) OVER f AS b, string_agg(line, chr(10)) OVER f AS whole, sum(w) OVER f AS words FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
ranked AS (SELECT doc_id, a, b, dense_rank() OVER (PARTITION BY whole ORDER BY doc_id, a) AS turn FROM windows WHERE words >= {MIN_WORDS}),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN ranked r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.a AND r.b WHERE r.turn > 1),
split_ AS (
  SELECT doc_id, i - 1 AS pos, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (WHERE g.pos IS NULL) AS text,
         count(*)::INTEGER AS n_lines, count(g.pos)::INTEGER AS n_removed
  FROM split_ s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
