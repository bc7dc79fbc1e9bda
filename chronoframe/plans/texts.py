"""Queries on text: vocabularies, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions import text as tx
from chronoframe.plans.registry import query
from chronoframe.plans.views import FRAMES, frames, table


@query("""WITH w AS (SELECT p_partkey, unnest(list_filter(list_transform(string_split(lower(replace(replace(p_type, ' ', '/'), '/', ',')), ','), lambda x: trim(x)), lambda x: x <> '')) AS word FROM part)
SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM w GROUP BY word""")
def vocab_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(tx.labels_of(F.replace("p_type", F.lit(" "), F.lit("/")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


@query(f"""WITH {FRAMES}, seen AS (SELECT episode_id, list_sort(list_distinct(list(object))) AS objects FROM frames GROUP BY 1)
SELECT episode_id, 'Objects:' || chr(10) || array_to_string(list_transform(objects, lambda x, i: i || '. ' || x), chr(10)) || chr(10) || 'Episode ' || episode_id || ' has ' || len(objects) || ' objects.' AS prompt FROM seen""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = frames(spark, sf_dir).groupBy("episode_id").agg(F.array_sort(F.collect_set("object")).alias("objects"))
    template = F.lit("Objects:\n{list}\nEpisode {id} has {n} objects.")
    prompt = tx.filled(template, list=tx.numbered(F.col("objects")), id=F.col("episode_id").cast("string"), n=F.size("objects").cast("string"))
    return seen.select("episode_id", prompt.alias("prompt"))


@query("""WITH a AS (SELECT p_partkey, string_split(p_name || '; ' || p_type, ';') AS t, string_split(p_size || ',x', ',') AS c FROM part)
SELECT p_partkey, array_to_string(list_filter(list_transform(t, lambda x: trim(x)), lambda x: x <> ''), '|') AS tasks,
       array_to_string(list_transform(c, lambda x: coalesce(TRY_CAST(trim(x) AS DOUBLE), 0)::DOUBLE::INTEGER::VARCHAR), '|') AS scores FROM a""")
def parse_llm_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model gives them: fenced JSON with tasks and confidences, one of which is not a number."""
    json = F.concat(F.lit('```json\n{"tasks":"'), "p_name", F.lit("; "), "p_type", F.lit('","confidence":"'), F.col("p_size").cast("string"), F.lit(',x"}\n```'))
    answer = table(spark, sf_dir, "part").select("p_partkey", tx.parsed_answer(json).alias("a"))
    scores = F.transform("a.scores", lambda s: s.cast("int").cast("string"))
    return answer.select("p_partkey", F.array_join("a.tasks", "|").alias("tasks"), F.array_join(scores, "|").alias("scores"))


@query("SELECT p_partkey, 'a photo of a ' || lower(p_name) || '.' AS text, 'photo' AS kind FROM part UNION ALL SELECT p_partkey, 'a drawing of the ' || lower(p_name) || '.', 'drawing' FROM part")
def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("kind")) for t, k in (("a photo of a {}.", "photo"), ("a drawing of the {}.", "drawing"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), F.explode(templates).alias("x"))
    return rows.select("p_partkey", F.replace("x.t", F.lit("{}"), "name").alias("text"), F.col("x.kind").alias("kind"))


@query("""SELECT p_partkey, CASE WHEN (contains(lower(p_type), 'brass')::INTEGER + contains(lower(p_type), 'tin')::INTEGER + contains(lower(p_type), 'steel')::INTEGER) = 1
THEN CASE WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'tin') THEN 'tin' ELSE 'steel' END END AS state FROM part""")
def single_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one state that a text mentions."""
    states = F.array(F.lit("brass"), F.lit("tin"), F.lit("steel"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.only_state(F.col("p_type"), states).alias("state"))


@query("""WITH c AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, t AS transcript, n FROM c""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one text each, in order of their turns."""
    line = F.concat("role", F.lit(": "), "text")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("all"), F.count("*").alias("n"))
    return turns.select("conv_id", F.array_join(F.transform("all", lambda s: s.l), "\n").alias("transcript"), "n")


@query("""SELECT p_partkey, p_name || '|' || p_type AS tasks FROM part""")
def repair_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated JSON answers made whole."""
    cut = F.concat(F.lit('{"tasks": ["'), "p_name", F.lit('", "'), "p_type")
    fixed = table(spark, sf_dir, "part").select("p_partkey", tx.repair_json(cut).alias("json"))
    return fixed.select("p_partkey", F.array_join(F.from_json("json", "tasks array<string>").tasks, "|").alias("tasks"))


@query("""WITH d AS (SELECT p_partkey, c, levenshtein(c, lower(p_brand)) AS d FROM part, (SELECT unnest(['brand#1', 'brand#22', 'brand#55']) AS c)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, c) AS r FROM d) SELECT p_partkey, c AS "match" FROM r WHERE r = 1""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = F.array(*map(F.lit, ("brand#1", "brand#22", "brand#55")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.best_match(F.lower("p_brand"), candidates).alias("match"))
