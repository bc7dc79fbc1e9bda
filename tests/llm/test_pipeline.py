"""The pipeline's stages one after the other against plain versions of what each may do."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoframe.llm.common import Scratch, passing
from tests.llm.conftest import prose
from tests.llm.test_duplicates import brute_near

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, small):
    """(rows before, rows after) of each stage by name."""
    scratch, out = Scratch(spark), {}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = scratch.keep(stage(spark, docs, small), f"test-{k}")
        out[name] = (docs, after)
        docs = after
    return out


@pytest.fixture(scope="module")
def filtered(spark):
    """The two filters on tables with enough labels to learn from."""
    scratch, out = Scratch(spark), {}
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        after = scratch.keep(stage(spark, docs, LARGER), name)
        out[name], docs = (docs, after), after
    return out


def test_columns(stages, spark, small):
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    *first, _ = stages.values()
    assert all(after.columns == columns for _, after in first)


@pytest.mark.parametrize(("name", "label", "bad"), [("toxicity", "toxic", 1), ("quality", "quality", 0)])
def test_filters_reject_few_good_and_most_bad(filtered, spark, name, label, bad):
    before, after = (df.select("doc_id") for df in filtered[name])
    assert after.join(before, "doc_id", "left_anti").isEmpty()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label).filter(f"{label} is not null")
    share = {}
    for value in (0, 1):
        there = labels.filter(f"{label} = {value}").join(before, "doc_id", "left_semi")
        share[value] = there.join(after, "doc_id", "left_semi").count() / max(1, there.count())
    assert share[1 - bad] >= 0.9 and share[bad] <= 0.2


def test_line_dedup_keeps_rows(stages):
    before, after = stages["line dedup"]
    assert before.count() == after.count()


def test_one_of_each_class_stays(stages):
    before, after = stages["near duplicates"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == {k for k, (c, _) in brute_near(texts).items() if k == c}


def test_packing_holds_all_that_is_left(stages):
    before, after = stages["packing"]
    pieces = after.toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in before.collect()}
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    filled = pieces.groupby("sequence_id").length.sum()
    assert (filled[filled.index < filled.index.max()] == 4096).all()
    assert (np.array([len(x) for x in pieces.ids]) == 4 * pieces.length).all()


def chained(spark, docs, sf_dir):
    """(rows before, rows after) of each stage by name, one after the other."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = Scratch(spark).keep(stage(spark, docs, sf_dir), "chained")
        out[name] = (docs.count(), after.count())
        docs = after
    return docs, out


def test_awkward_rows_through_all_stages(spark, awkward, nothing, small):
    """Null, empty, blank, long and repeated texts, null and repeated keys, clashing names; and no rows at all."""
    more = awkward.limit(8).withColumn("doc_id", F.lit(None).cast("long"))
    docs = awkward.unionByName(awkward).unionByName(more)
    packed, counts = chained(spark, docs, small)
    assert counts["toxicity"][1] <= docs.count() and counts["line dedup"][0] == counts["line dedup"][1]
    assert all(0 < r.length <= 4096 for r in packed.collect())
    last = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert last <= {r.doc_id for r in docs.select("doc_id").collect()}
    packed, counts = chained(spark, nothing, small)
    assert packed.count() == 0 and set(counts.values()) == {(0, 0)}


def test_run_leaves_no_tables_of_its_stages(spark, small):
    with passing():
        packed = corpus_pipeline.run(spark, small)
        assert packed.count() > 0
        root = Path(packed.inputFiles()[0].removeprefix("file://")).parents[2]
        own = [p.name for table in root.glob("tables-*") for p in table.iterdir()]
        assert "stage-0" not in own and "signed" not in own and "covering" not in own


def test_copies_end_as_one_document(spark, small):
    """A group of exact copies, and documents that others hold as a whole, from the line dedup to the packing."""
    base = prose(80, 7)
    texts = [base + " " + prose(50, 8)] + [prose(120, 9)] * 40 + [base] * 30 + [prose(70, 11)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES[2:]:
        docs = Scratch(spark).keep(stage(spark, docs, small), "copies")
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {0, 1, 41, 71}
