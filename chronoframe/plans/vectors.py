"""Queries on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions import vectors as vx
from chronoframe.plans.registry import query
from chronoframe.plans.views import table

CENTROIDS = """places AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
centroids AS (SELECT label AS class, list(v ORDER BY i) AS c FROM places GROUP BY 1),
sims AS (SELECT vec_id, label, class, list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))) AS s FROM embeddings, centroids)"""


def centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and the mean vector of each label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return e, vx.mean_vectors(e, ["label"], "embedding", "centroid").withColumnRenamed("label", "class")


@query(f"WITH {CENTROIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, class) AS rank FROM sims) SELECT vec_id, class, rank::INTEGER AS rank, round(s, 6) AS cosine FROM r WHERE rank <= 3")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vx.nearest_classes(*centroids(spark, sf_dir), "class", "embedding", "centroid", 3)
    top = best.select("vec_id", F.posexplode("nearest").alias("pos", "n"))
    return top.select("vec_id", F.col("n.key").alias("class"), (F.col("pos") + 1).alias("rank"), F.round("n.cosine", 6).alias("cosine"))


@query(f"WITH {CENTROIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, class) AS r FROM sims) SELECT vec_id, label, class AS predicted, label = class AS correct FROM r WHERE r = 1")
def centroid_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vx.nearest_classes(*centroids(spark, sf_dir), "class", "embedding", "centroid", 1)
    found = F.col("nearest")[0]["key"]
    return best.select("vec_id", "label", found.alias("predicted"), (F.col("label") == found).alias("correct"))


@query(f"""WITH {CENTROIDS}, e AS (SELECT *, exp(10 * s - max(10 * s) OVER (PARTITION BY vec_id)) AS e FROM sims)
SELECT vec_id, class, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS softmax, round(1 / (1 + exp(-(10 * s - 2))), 6) AS sigmoid FROM e""")
def sigmoid_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vx.similarities(*centroids(spark, sf_dir), "class", "embedding", "centroid")
    return s.select(
        "vec_id", "class", F.round(vx.softmax(10 * F.col("cosine"), ["vec_id"]), 6).alias("softmax"), F.round(vx.sigmoid(10 * F.col("cosine") - 2), 6).alias("sigmoid")
    )


@query()
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running de-duplication of proposals: in order of vec_id, one joins the nearest memory entry of its label at a cosine of 0.3 or more and moves its mean, else it starts one."""
    return online_entries(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3)


def online_entries(rows: DataFrame, part: str, order: str, vector: str, least: float) -> DataFrame:
    """(part, order, entry): the running assignment of each part's vectors, in order, to entries with moving means.

    Each decision needs those before it, so a part's rows pass through one task one after the other; the task
    holds the entries' means and nothing else of the part. Null vectors are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory, sizes = None, np.zeros((0, 0)), []
        for batch in batches:
            parts, entries = batch.column(0).to_pylist(), []
            for value, v in zip(parts, batch.column(2).to_pylist(), strict=True):
                x = np.asarray(v, float)
                x = x / max(np.linalg.norm(x), 1e-12)
                if value != now or not sizes:
                    now, memory, sizes = value, np.zeros((0, len(x))), []
                sims = memory @ x / np.maximum(np.linalg.norm(memory, axis=1), 1e-12)
                if len(sims) and sims.max() >= least:
                    k = int(sims.argmax())
                    memory[k] = (memory[k] * sizes[k] + x) / (sizes[k] + 1)
                    sizes[k] += 1
                else:
                    k = len(sizes)
                    memory = np.concatenate((memory, x[None]))
                    sizes.append(1)
                entries.append(k)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(entries, pa.int32())], names=[part, order, "entry"])

    known = rows.filter(F.col(vector).isNotNull()).select(part, order, vector)
    ordered = known.repartition(part).sortWithinPartitions(part, order)
    kind = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    return ordered.mapInArrow(run, f"{part} {kind[part]}, {order} {kind[order]}, entry int")
