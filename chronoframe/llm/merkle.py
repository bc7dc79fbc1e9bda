"""Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups, and a proof for every row.

Every node is the lowercase hex SHA-256 of up to FAN nodes of the level below it, as text, one after the other.

*Order.* Leaves are dealt by range and sorted; a row's rank in its group is its place in its partition plus what the
partitions before hold of the group. Those sums have one row for each partition and group, so a group that holds
most of the rows is as cheap as many small ones.
*Blocks.* FAN ** levels neighbours are one array. ``slice`` cuts it into runs, ``transform`` hashes the runs, ``aggregate``
goes from level to level; the block's last level is one node. The roots of a group's blocks are the leaves of the next round,
until each group has one block: rounds grow with the logarithm of the rows. A last block that isn't full goes up
as many levels as the others do.
*Proofs.* From the last round down each block hands its members the hashes beside their way up. Blocks and their roots
meet one to one, so nothing is ever joined by the group alone.

All work on rows is in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, in_fold, passing

FAN = 3
#: A block has FAN ** LEVELS leaves: with their levels about 100 kB.
LEVELS = 6


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields, each `-` where null, else its count of UTF-8 bytes, a colon and its text."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def _ranked(leaves: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``leaves`` (g, ...) with each row's ``rank`` in its group, by ``order``, and the group's rows ``m``."""
    placed = leaves.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = scratch.keep(placed.withColumn("at", F.monotonically_increasing_id()), f"{name}-placed")
    part = F.shiftrightunsigned("at", 33).alias("part")
    runs = placed.groupBy("g", part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("g")
    earlier = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("g", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("m"))
    return placed.withColumn("part", part).join(runs, ["g", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _collapsed(nodes: Column) -> Column:
    """The level above: the hash of each run of FAN nodes, the last run what is left."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / F.lit(FAN)).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _steps(h: Column, levels: int) -> Column:
    """1 to h as an array, empty for 0."""
    return F.slice(F.array(*(F.lit(k) for k in range(1, levels + 1))), F.lit(1), h)


def _rounds(ranked: DataFrame, carried: list[str], levels: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round (g, block, h, members, nodes), and (g, leaf) of each group's root."""
    size, rounds = FAN**levels, []
    while True:
        members = F.sort_array(F.collect_list(F.struct("rank", "leaf", *carried)))
        blocks = ranked.groupBy("g", F.floor(F.col("rank") / F.lit(size)).alias("block")).agg(F.max("m").alias("m"), members.alias("members"))
        # A level is needed while the group has more than one node left on it.
        needed = sum((F.col("m") > FAN**k).cast("int") for k in range(levels))
        up = F.aggregate(
            _steps(F.col("h"), levels), F.array(F.col("members.leaf")), lambda nodes, _: F.concat(nodes, F.array(_collapsed(F.element_at(nodes, -1))))
        )
        rounds.append(scratch.keep(blocks.withColumn("h", needed).withColumn("nodes", up), f"{name}-{len(rounds)}"))
        root = F.element_at(F.element_at("nodes", -1), 1).alias("leaf")
        ranked, carried = rounds[-1].select("g", F.col("block").alias("rank"), F.ceil(F.col("m") / F.lit(size)).alias("m"), root), []
        if (ranked.agg(F.max("m")).first()[0] or 0) <= 1:
            return rounds, ranked.select("g", "leaf")


def _proofs(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """Each leaf of the first round with its group's columns of ``tops`` (g, path, ...) and its own way up before theirs."""
    powers = F.array(*(F.lit(FAN**k) for k in range(levels + 1)))

    def beside(i: Column, j: Column) -> Column:
        """What stands left and right of the ancestor on level j of member i in its run."""
        nodes, at = F.element_at("nodes", j), F.floor(i / F.element_at(powers, j)).cast("int")
        first = F.floor(at / F.lit(FAN)).cast("int") * FAN
        left, right = F.slice(nodes, first + 1, at - first), F.slice(nodes, at + 2, first + FAN - 1 - at)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    given = [c for c in tops.columns if c not in ("g", "path")]
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        ways = F.transform("members", lambda x, i: F.struct(x.alias("member"), F.transform(_steps(F.col("h"), levels), lambda j: beside(i, j)).alias("way")))
        found = blocks.withColumn("ways", ways).drop("members", "nodes", "m", "h").join(paths, ["g", "block"])
        found = found.select("g", *given, F.col("path").alias("upper"), F.explode("ways").alias("x"))
        paths = found.select("g", *given, F.col("x.member").alias("member"), F.col("x.member.rank").alias("block"), F.concat("x.way", "upper").alias("path"))
        last, paths = paths, paths.drop("member")
    return last.select("g", *given, "member.*", "path")


def manifest(docs: DataFrame, leaf: Column, key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, group, leaf, carried columns, subroot, root, path) of every row.

    Leaves ascend by ``key`` (null first, then leaf and carried text) within their group, groups by their value (null first,
    bytewise). ``subroot`` is the group's root, ``root`` that of all subroots. ``path`` has, level by level up to the root, the
    hashes that stand left and right of the row's ancestor in its run, each as one text. ``carry`` are text columns computed
    from ``docs`` that come back beside the leaf. An empty table has no rows and no root; repeated rows are leaves of their own; other columns of ``docs``
    are not looked at but by ``leaf`` and ``carry``.
    """
    carry = carry or {}
    last = Scratch(docs.sparkSession)
    with passing():
        scratch = Scratch(docs.sparkSession)
        leaves = docs.select(F.struct(F.col(group).alias("v")).alias("g"), F.col(key).alias("k"), leaf.alias("leaf"), *(c.alias(f"c_{n}") for n, c in carry.items()))
        # Equal rows are told apart by their place, so that many of them don't meet in one range.
        leaves = scratch.keep(leaves.withColumn("place", F.monotonically_increasing_id()), "leaves")
        named = [f"c_{n}" for n in carry]
        rows, subroots = _rounds(_ranked(leaves, ["k", "leaf", *named, "place"], scratch, "leaf"), ["k", *named], levels, scratch, "rows")
        tops = scratch.keep(subroots.select(F.struct(F.lit(0).alias("v")).alias("g"), F.col("g").alias("k"), "leaf"), "subroots")
        groups, roots = _rounds(_ranked(tops, ["k"], scratch, "group"), ["k"], levels, scratch, "groups")
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        above = _proofs(groups, roots.select("g", F.col("leaf").alias("root"), nothing.alias("path")), levels)
        tops = above.select(F.col("k").alias("g"), F.col("leaf").alias("subroot"), "root", "path")
        proofs = _proofs(rows, tops, levels)
        carried = [F.col(f"c_{n}").alias(n) for n in carry]
        return last.keep(proofs.select(F.col("k").alias(key), F.col("g.v").alias(group), "leaf", *carried, "subroot", "root", "path"), "manifest")


def proof_hash(path: Column) -> Column:
    """Hash of all that stands beside a row's way up, level by level, left to right; of the empty text where nothing does."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x.left, x.right)), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to: the manifest's root if and only if the row is the one that was hashed."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x.left, node, x.right), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tamper_check(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs`` held against a copy whose texts have lost their line feeds where crc32 of the key is even.

    doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row. A null key is not tampered with; nor is a null text.
    """
    text = F.when(in_fold(F.col("doc_id"), 2, 0), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = leaf_hash(*(text if c == "text" else F.col(c) for c in FIELDS))
    told = manifest(docs, leaf_hash(*map(F.col, FIELDS)), carry={"found": found}, levels=levels)
    told = told.withColumns({"proof_sha256": proof_hash(F.col("path")), "folded_root": folded(F.col("found"), F.col("path"))})
    return told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, source, lang, n_chars, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(
      range(1, length(doc_id::VARCHAR) + 1), lambda i: [ord(substr(doc_id::VARCHAR, i::INTEGER, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, v: xor(xor(c, v) >> 1, 3988292384::UBIGINT * (xor(c, v) & 1::UBIGINT))), 4294967295::UBIGINT) AS crc FROM documents),
leaves AS (
  SELECT doc_id, source, sha256({" || ".join(_field(c) for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_field("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END" if c == "text" else c) for c in FIELDS)}) AS found,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM crc),
rows_ AS (
  SELECT source, 0 AS level, pos, leaf AS h, n AS m FROM leaves
  UNION ALL
  SELECT source, any_value(level) + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)), (any_value(m) + {FAN - 1}) // {FAN}
  FROM rows_ WHERE m > 1 GROUP BY source, pos // {FAN}),
subroots AS (
  SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM rows_ WHERE m = 1),
groups_ AS (
  SELECT 0 AS level, pos, subroot AS h, n AS m FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)), (any_value(m) + {FAN - 1}) // {FAN} FROM groups_ WHERE m > 1 GROUP BY pos // {FAN}),
top AS (SELECT h AS root, level AS height FROM groups_ WHERE m = 1),
way AS (
  SELECT l.doc_id, r.level, coalesce(string_agg(r.h, '' ORDER BY r.pos) FILTER (WHERE r.pos < p.at), '') AS left_, coalesce(string_agg(r.h, '' ORDER BY r.pos) FILTER (WHERE r.pos > p.at), '') AS right_
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, generate_series(0, s.height - 1) g(level),
    LATERAL (SELECT l.pos // ({FAN}::BIGINT ** g.level)::BIGINT AS at) p
  JOIN rows_ r ON r.source IS NOT DISTINCT FROM l.source AND r.level = g.level AND r.pos // {FAN} = p.at // {FAN} GROUP BY l.doc_id, r.level
  UNION ALL
  SELECT l.doc_id, s.height + r.level, coalesce(string_agg(r.h, '' ORDER BY r.pos) FILTER (WHERE r.pos < p.at), ''), coalesce(string_agg(r.h, '' ORDER BY r.pos) FILTER (WHERE r.pos > p.at), '')
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, top t, generate_series(0, t.height - 1) g(level),
    LATERAL (SELECT s.pos // ({FAN}::BIGINT ** g.level)::BIGINT AS at) p
  JOIN groups_ r ON r.level = g.level AND r.pos // {FAN} = p.at // {FAN} GROUP BY l.doc_id, s.height, r.level),
path AS (SELECT doc_id, string_agg(left_ || right_, '' ORDER BY level) AS beside, list(left_ ORDER BY level) AS lefts, list(right_ ORDER BY level) AS rights FROM way GROUP BY doc_id),
fold AS (
  SELECT l.doc_id, l.found AS node, 1 AS step, p.lefts, p.rights FROM leaves l LEFT JOIN path p ON l.doc_id = p.doc_id
  UNION ALL
  SELECT doc_id, sha256(lefts[step] || node || rights[step]), step + 1, lefts, rights FROM fold WHERE step <= len(lefts))
SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(coalesce(p.beside, '')) AS proof_sha256, f.node AS folded_root, f.node = t.root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN top t LEFT JOIN path p ON l.doc_id = p.doc_id
JOIN fold f ON f.doc_id = l.doc_id AND f.step = coalesce(len(f.lefts), 0) + 1
"""
