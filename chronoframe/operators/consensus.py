"""Consensus of the segments that several frames of a voting window show: the heaviest set without conflicts, exactly."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.boxes import box, iou

#: Weights are whole numbers of this unit, so that sums are exact and ties are ties.
UNIT = 1e-9


def _parts(nodes: int, adjacent: list[int]) -> list[int]:
    """Connected components of the nodes in a bit set."""
    out = []
    while nodes:
        part = front = nodes & -nodes
        while front:
            reach, rest = 0, front
            while rest:
                low = rest & -rest
                reach |= adjacent[low.bit_length() - 1]
                rest ^= low
            front = reach & nodes & ~part
            part |= front
        out.append(part)
        nodes &= ~part
    return out


def heaviest(weights: list[int], adjacent: list[int]) -> int:
    """The set (as bits) of nodes without two adjacent ones that weighs most; among equal ones that with the smallest numbers.

    Branch and bound: a set of nodes is cut into its components; in one, either its best connected node is
    taken, and its neighbours fall away, or it is left out. A branch ends where the heaviest node of each clique of a greedy cover
    together can't beat the best set so far. Exact at every size; components of some hundred nodes with few conflicts each take milliseconds, dense ones
    of any size are few cliques.
    """
    n = len(weights)
    # Below the weight each node has a bit of its own: no two sets weigh the same, and small numbers go first.
    value = [(w << n) | (1 << (n - 1 - i)) for i, w in enumerate(weights)]
    known: dict[int, tuple[int, int]] = {0: (0, 0)}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * n + 1000))

    def bits(nodes: int) -> list[int]:
        out = []
        while nodes:
            low = nodes & -nodes
            out.append(low.bit_length() - 1)
            nodes ^= low
        return out

    def bound(nodes: int) -> int:
        total = 0
        while nodes:
            first = clique = nodes & -nodes
            most, common = value[first.bit_length() - 1], adjacent[first.bit_length() - 1] & nodes
            while common:
                low = common & -common
                most, clique = max(most, value[low.bit_length() - 1]), clique | low
                common &= adjacent[low.bit_length() - 1]
            total += most
            nodes &= ~clique
        return total

    def best(nodes: int) -> tuple[int, int]:
        if nodes in known:
            return known[nodes]
        parts = _parts(nodes, adjacent)
        if len(parts) > 1:
            found = [best(p) for p in parts]
            out = (sum(f[0] for f in found), sum(f[1] for f in found))
        else:
            pivot = max(bits(nodes), key=lambda i: (bin(adjacent[i] & nodes).count("1"), value[i]))
            rest = nodes & ~(1 << pivot)
            with_ = best(rest & ~adjacent[pivot])
            out = (with_[0] + value[pivot], with_[1] | 1 << pivot)
            if bound(rest) > out[0]:
                out = max(out, best(rest))
        known[nodes] = out
        return out

    return best(sum(1 << i for i, w in enumerate(weights) if w > 0))[1]


def consensus(segments: DataFrame, group: list[str], frame: str, id_: str, score: str, frames: int) -> DataFrame:
    """(group, id, n_matching, score): the segments that stand for a voting window of ``frames`` frames.

    Segments of different frames whose boxes overlap by more than half match, and conflict. A segment weighs twice the sum of its overlaps less one;
    the heaviest set without conflicts is kept (at equal weight the smaller ids), so a segment that no other frame shows goes. A kept
    segment's score is the mean of its own and its matches', less a fifth of what its share of matching frames lacks of a half. A window's
    segments, which are those of a few frames, are one task's; windows are independent. A null id, frame or group is left out.
    """
    rows = segments.select(*group, frame, id_, score, "x1", "y1", "x2", "y2").filter(" and ".join(f"{c} is not null" for c in (*group, frame, id_)))
    other = rows.select(*group, *(F.col(c).alias(f"r_{c}") for c in (frame, id_, score, "x1", "y1", "x2", "y2")))
    # A pair is looked at from both sides, for each counts it.
    pairs = rows.join(other, group).filter(F.col(frame) != F.col(f"r_{frame}")).withColumn("overlap_", iou(box(), box("r_"))).filter("overlap_ > 0.5")
    nodes = pairs.groupBy(*group, id_).agg(
        F.round((2 * F.sum("overlap_") - 1) / UNIT).cast("long").alias("weight"), F.collect_list(f"r_{id_}").alias("others"),
        F.count("*").alias("n_matching"), ((F.first(score) + F.sum(f"r_{score}")) / (1 + F.count("*"))).alias("mean_"),
    )

    def run(window: list) -> list[bool]:
        place = {node["id"]: k for k, node in enumerate(window)}
        chosen = heaviest([node["weight"] for node in window], [sum(1 << place[o] for o in set(node["others"])) for node in window])
        return [bool(chosen >> k & 1) for k in range(len(window))]

    # As many tasks as the session shuffles to: the work is in Python, however few bytes it is.
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = F.struct(F.col(id_).alias("id"), "weight", "others", "n_matching", "mean_")
    windows = nodes.repartition(tasks, *group).groupBy(*group).agg(F.sort_array(F.collect_list(node)).alias("nodes_"))
    chosen = F.udf(run, "array<boolean>", useArrow=True)("nodes_")
    kept = windows.withColumn("chosen_", chosen).select(*group, F.explode(F.arrays_zip("nodes_", "chosen_")).alias("k_")).filter("k_.chosen_")
    kept = kept.select(*group, F.col("k_.nodes_.id").alias(id_), F.col("k_.nodes_.n_matching").alias("n_matching"), F.col("k_.nodes_.mean_").alias("mean_"))
    lacks = F.greatest(F.lit(0.0), (F.lit(0.5) - F.col("n_matching") / (frames - 1)) * 0.2)
    return kept.select(*group, id_, "n_matching", (F.col("mean_") - lacks).alias("score"))
