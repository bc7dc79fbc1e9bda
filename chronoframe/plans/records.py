"""Queries on labels, tracks, tokens, shards and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions import text as tx
from chronoframe.functions import vectors as vx
from chronoframe.operators import grids, metrics, series, voting
from chronoframe.plans.registry import query
from chronoframe.plans.views import FRAMES, episode, frames, table


@query(f"""WITH {FRAMES} SELECT episode_id, frame_idx, (ceil(frame_idx / 8) * 8)::INTEGER AS sampled FROM frames WHERE object = 'purchase' AND frame_idx BETWEEN 10 AND 60""")
def sampled_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated frames of a stretch, each moved on to the next sampled frame."""
    marked = frames(spark, sf_dir).filter("object = 'purchase'").select("episode_id", "frame_idx")
    return grids.moved_to_samples(marked, "frame_idx", 10, 60, 8, "sampled")


@query(f"""WITH RECURSIVE {FRAMES}, o AS (SELECT episode_id, frame_idx, row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx) AS rn FROM frames WHERE object IN ('purchase', 'view')),
walk AS (SELECT episode_id, rn, frame_idx AS kept, true AS stays, frame_idx FROM o WHERE rn = 1
  UNION ALL SELECT o.episode_id, o.rn, CASE WHEN o.frame_idx - w.kept > 3 THEN o.frame_idx ELSE w.kept END, o.frame_idx - w.kept > 3, o.frame_idx FROM walk w JOIN o ON o.episode_id = w.episode_id AND o.rn = w.rn + 1)
SELECT episode_id, frame_idx FROM walk WHERE stays""")
def spaced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames more than three after the last one kept."""
    return series.spaced(frames(spark, sf_dir).filter("object in ('purchase', 'view')"), "episode_id", "frame_idx", 3)


@query("""SELECT p_partkey, CASE WHEN p_size / 50.0 <= 0.1 OR contains(p_name, 'a') THEN -1 ELSE p_size / 50.0 END AS score, p_size / 50.0 > 0.1 AND NOT contains(p_name, 'a') AS kept FROM part""")
def gated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score and tasks; the others are marked by a score of -1 (a name with an "a" stands for an answer without tasks)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50).alias("score"), F.when(~F.contains("p_name", F.lit("a")), F.array("p_name")).alias("tasks"))
    return voting.gated(rows, "score", "tasks", 0.1).select("p_partkey", "score", "kept")


@query(f"""WITH {FRAMES} SELECT episode_id, (frame_idx // 10)::INTEGER AS g, count(*) FILTER (WHERE k > 70) > 0.1 * count(*) AS occluded FROM frames GROUP BY 1, 2""")
def occluded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of which the robot's mask covers more than a tenth (pixels with k above 70)."""
    g = frames(spark, sf_dir).withColumn("g", F.floor(F.col("frame_idx") / 10).cast("int"))
    return g.groupBy("episode_id", "g").agg((F.count(F.when(F.col("k") > 70, 1)) > 0.1 * F.count("*")).alias("occluded"))


@query(f"""WITH {FRAMES} SELECT episode_id, string_agg(state || ':' || k, ',' ORDER BY frame_idx) AS pairs FROM frames WHERE state IS NOT NULL GROUP BY 1""")
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aligned lists of an episode without the places at which one is null."""
    lists = grids.stacked(frames(spark, sf_dir), ["episode_id"], "frame_idx", ["state", "k"])
    both = grids.zipped(F.col("state"), F.col("k"))
    return lists.select("episode_id", F.array_join(F.transform(both, lambda p: F.concat(p["0"], F.lit(":"), p["1"].cast("string"))), ",").alias("pairs"))


@query("""SELECT n_name, coalesce(lower(r_name) || ',' || lower(n_name), lower(n_name)) AS names, n_name NOT IN ('CHINA', 'FRANCE', 'nation_3') AS wanted FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def synonym_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their synonyms, where there are any, and whether a name is on the list of those left out."""
    synonyms = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("synonym"))
    found = table(spark, sf_dir, "nation").join(synonyms, "n_regionkey", "left")
    return found.select("n_name", F.concat_ws(",", "synonym", F.lower("n_name")).alias("names"), (~F.col("n_name").isin("CHINA", "FRANCE", "nation_3")).alias("wanted"))


@query(f"""WITH {FRAMES}, s AS (SELECT *, sum((object = 'purchase')::INTEGER) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS part FROM frames),
c AS (SELECT episode_id, part, object, count(*) AS n FROM s GROUP BY 1, 2, 3), m AS (SELECT *, row_number() OVER (PARTITION BY episode_id, part ORDER BY n DESC, object) AS r FROM c)
SELECT episode_id, avg((object = 'view')::INTEGER) AS accuracy, count(*) AS segments FROM m WHERE r = 1 GROUP BY 1""")
def segment_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the stretches between purchases whose most frequent class is the wanted one (view)."""
    cut = frames(spark, sf_dir).withColumn("part", F.sum((F.col("object") == "purchase").cast("int")).over(series.upto(episode())))
    return metrics.segment_accuracy(cut, "episode_id", "part", "object", F.lit("view"))


TRACKS = f"""{FRAMES}, t AS (SELECT episode_id, k % 7 AS track, object AS class, value / 500 AS score, k FROM frames),
votes AS (SELECT episode_id, track, class, avg(score) AS m, sum(score) AS s, count(*) AS n, min(k) AS lo, max(k) AS hi FROM t GROUP BY 1, 2, 3),
allof AS (SELECT episode_id, track, count(*) AS n_all FROM t GROUP BY 1, 2)"""


@query(f"""WITH {TRACKS}, b AS (SELECT *, row_number() OVER (PARTITION BY episode_id, class ORDER BY round(m + 0.5 * s, 9) DESC, track) AS r FROM votes),
f AS (SELECT b.*, first_value(lo) OVER w AS blo, first_value(hi) OVER w AS bhi FROM b WINDOW w AS (PARTITION BY episode_id, class ORDER BY r))
SELECT episode_id, track, class, r = 1 OR n > 5 OR (lo <= bhi + 2 AND hi >= blo - 2) AS kept FROM f""")
def outlier_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several tracks of a class the best stays, with those in contact with it and those seen often."""
    t = frames(spark, sf_dir).select("episode_id", (F.col("k") % 7).alias("track"), F.col("object").alias("class"), (F.col("value") / 500).alias("score"), "k")
    return voting.clean_tracks(t, "episode_id", "track", "class", "score", "k", 5, 2).select("episode_id", "track", "class", "kept")


@query(f"""WITH {TRACKS} SELECT v.episode_id, class, round(0.9 * sum(m) + 0.1 * sum((n / n_all - 0.5) / 0.5) / count(*), 6) AS score FROM votes v JOIN allof a ON v.episode_id = a.episode_id AND v.track = a.track GROUP BY 1, 2""")
def class_mask_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the merged masks of a class: its tracks' mean scores and how consistently they are of that class."""
    t = frames(spark, sf_dir).select("episode_id", (F.col("k") % 7).alias("track"), F.col("object").alias("class"), (F.col("value") / 500).alias("score"))
    return voting.class_scores(t, "episode_id", "track", "class", "score").withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1) // 9 AS class, (generate_subscripts(embedding, 1) - 1) % 9 AS place, unnest(embedding)::DOUBLE AS p FROM embeddings)
SELECT vec_id, class::INTEGER AS class, round(avg(p), 6) AS score FROM t WHERE place < 8 GROUP BY 1, 2 HAVING avg(p) > 0.02""")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability of each class's tokens (eight each, one apart) where it exceeds the limit."""
    found = tx.span_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 1)
    return found.filter("score > 0.02").select("vec_id", "class", F.round("score", 6).alias("score"))


@query(f"""WITH {FRAMES}, b AS (SELECT episode_id, min(frame_idx) FILTER (WHERE object = 'signup') AS s FROM frames GROUP BY 1),
e AS (SELECT f.episode_id, any_value(s) AS s, min(frame_idx) FILTER (WHERE object = 'purchase') AS e FROM frames f JOIN b ON f.episode_id = b.episode_id WHERE frame_idx >= s GROUP BY 1)
SELECT f.episode_id, exp(-sum(value / 1000)) AS probability FROM frames f JOIN e ON f.episode_id = e.episode_id WHERE frame_idx >= s AND (e IS NULL OR frame_idx < e) GROUP BY 1""")
def answer_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of an answer's tokens from the marker on (signup) up to the closing one (purchase)."""
    tokens = grids.stacked(frames(spark, sf_dir), ["episode_id"], "frame_idx", ["object", "value"])
    logs = F.transform("value", lambda v: -v / 1000)
    found = tokens.select("episode_id", tx.answer_probability(F.col("object"), logs, "signup", "purchase").alias("probability"))
    return found.filter("probability is not null")


@query("""SELECT conv_id, turn, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS digest FROM conversations""")
def collapsed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.collapsed(F.col("text")).cast("binary")).alias("digest"))


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]


def _unescaped(sql: str) -> str:
    for name, sign in _ENTITIES:
        sql = f"replace({sql}, '{name}', '{sign}')"
    return sql


@query(f"SELECT page_id, md5(trim({_unescaped(_unescaped('html'))})) AS digest FROM pages")
def unescaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named signs of pages resolved, twice."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(tx.unescaped(tx.unescaped(F.col("html")))).cast("binary")).alias("digest"))


@query("""WITH n AS (SELECT count(*) AS n FROM customer), w AS (SELECT unnest(range(7)) AS worker), b AS (SELECT worker, worker * ceil(n / 7) AS lo, least((worker + 1) * ceil(n / 7), n) AS hi FROM w, n)
SELECT worker::INTEGER AS worker, lo::BIGINT AS "start", hi::BIGINT AS "end", (SELECT count(*) FROM customer WHERE c_custkey - 1 >= lo AND c_custkey - 1 < hi) AS n FROM b""")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to seven workers in stretches of equal length."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("row"))
    bounds = grids.shard_bounds(spark, rows.count(), 7)
    per = rows.groupBy(grids.shard_of(F.col("row"), rows.count(), 7).alias("worker")).agg(F.count("*").alias("n"))
    return bounds.join(per, "worker", "left").select("worker", "start", "end", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square,
round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", vx.normalised(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(vx.dot(F.col("u"), F.col("u")), 6).alias("square"), F.round(F.col("u")[0], 6).alias("first"))


@query("""SELECT o_orderkey, o_custkey AS "customer.key", o_orderstatus AS "state.status", o_orderpriority AS "state.how.priority" FROM orders""")
def flat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as columns named by their path."""
    nested = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct(F.col("o_custkey").alias("key")).alias("customer"),
        F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("priority")).alias("how")).alias("state"),
    )
    return nested.select(*grids.flat_columns(nested))


@query(f"""WITH {FRAMES} SELECT episode_id, count(DISTINCT object) FILTER (WHERE object IN ('click', 'view', 'purchase')) = 3 AS all_there FROM frames GROUP BY 1""")
def complete_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an episode shows all the objects asked for."""
    wanted = F.array(*map(F.lit, ("click", "view", "purchase")))
    seen = frames(spark, sf_dir).groupBy("episode_id").agg(F.collect_set("object").alias("seen"))
    return seen.select("episode_id", (F.size(F.array_except(wanted, F.col("seen"))) == 0).alias("all_there"))
