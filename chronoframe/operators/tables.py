"""Written tables that cut lineage, joins that survive hot keys, and connected components on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows of a table that a task takes where steps make several of each.
TASK_ROWS = 50_000


def tasks_for(rows: DataFrame, per: int | None = None) -> int:
    """A task for every ``per`` rows (TASK_ROWS), and one for each core at least. The rows are counted, which costs little for a stored table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (per or TASK_ROWS)))


def dealt(rows: DataFrame, keys: list[str], per: int | None = None) -> DataFrame:
    """``rows`` dealt by ``keys`` to ``tasks_for`` them: what a task holds does not grow with the table.

    Unasked, Spark merges partitions by the bytes that are shuffled, not by what the steps after that make of them.
    """
    return rows.repartition(tasks_for(rows, per), *keys)


class Tables:
    """Parquet tables of one result in the folder that ``spark.checkpoint.dir`` names; they go when the application ends.

    Without that setting a local master takes a folder of its own; a cluster is refused, for executors don't share disks.
    Where ``shuffled``, no join broadcasts them unasked: Spark guesses their size by their files, and columns of numbers in order take many times that in memory.
    """

    def __init__(self, spark: SparkSession, shuffled: bool = False):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="chronoframe-")
        self.spark, self.root, self.shuffled = spark, f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}", shuffled
        self._files(self.root, "mkdirs")
        self._files(self.root, "deleteOnExit")

    def _files(self, path: str, what: str, *more: bool) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(at.getFileSystem(self.spark._jsc.hadoopConfiguration()), what)(at, *more)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, run once and read from its files from now on."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        kept = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        return kept.hint("merge") if self.shuffled else kept

    def drop(self, *names: str) -> None:
        for name in names:
            self._files(f"{self.root}/{name}", "delete", True)


def hot_join(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, which has one row a key and in ``count`` how many of the ``total`` rows bear it.

    Keys with more than ``total / HOT_SHARE`` rows are broadcast, at most HOT_SHARE of them: their rows stay where they lie. The rest is shuffled.
    """
    hot = F.col(count) > total / HOT_SHARE
    known = F.broadcast(unique.filter(hot))
    mine = rows.join(known, keys)
    rest = rows.join(F.broadcast(unique.filter(hot).select(*keys)), keys, "left_anti").join(unique.filter(~hot), keys)
    return mine.unionByName(rest)


def components(edges: DataFrame, keys: list[str], tables: Tables, name: str) -> DataFrame:
    """(keys, node, component): the smallest node that each node with an edge can reach; ``edges`` is (keys, u, v) of longs.

    Alternating rounds tie every node's larger neighbours to its smallest one, then all smaller ones; their number grows with
    the logarithm of the longest chain. Each round is written, so a lost executor repeats one at most.
    """
    small = edges.filter("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, turn = tables.keep(small, f"{name}-0"), 0
    total = now.count()
    while total:
        both = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.hint("merge") if tables.shuffled else both
        least = both.groupBy(*keys, "u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, least, [*keys, "u"], "n", 2 * total).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        large = tables.keep(large.distinct(), f"{name}-large")
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = hot_join(large, least, [*keys, "u"], "n", total)
        small = met.select(*keys, F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = tables.keep(small.select(*keys, "e.u", "e.v").filter("u <> v").distinct(), f"{name}-{turn + 1}")
        tables.drop(f"{name}-{turn}", f"{name}-large")
        # Only stars are left once no leaf has two centres and none is a centre.
        ends = small.select(*keys, F.col("u").alias("w"), F.lit(1).alias("leaf")).unionByName(small.select(*keys, F.col("v").alias("w"), F.lit(0).alias("leaf")))
        roles = ends.groupBy(*keys, "w").agg(F.sum("leaf").alias("as_leaf"), F.min("leaf").alias("only"))
        state = roles.agg(F.sum("as_leaf").alias("n"), F.max("as_leaf").alias("most"), F.max(F.col("as_leaf") > F.col("only")).alias("open")).first()
        now, turn, total = small, turn + 1, state.n
        if state.most == 1 and not state.open:
            break
    leaves = now.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct())
