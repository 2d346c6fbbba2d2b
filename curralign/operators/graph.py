"""Prerequisite graphs: neighbours between grades, closure, paths and comparisons.

Walks are semi-naive loops: the frontier joins the edges, what was seen is removed by an anti join, and every round is
checkpointed to the shared folder, so that plans stay short and lost executors cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import UNKNOWN, grade_rank
from .lineage import cut

HARD, SOFT = 0.9, 0.5


def consecutive_grades(standards: DataFrame, max_gap: int = 2) -> DataFrame:
    """``system, domain, rank, next_rank``: grades that follow each other within a system and domain, at most ``max_gap`` apart.

    Only the ten ranked grades take part. Grades outside them have no order.
    """
    grades = standards.select("system", "domain", grade_rank(F.col("grade")).alias("rank")).where(F.col("rank") < UNKNOWN).distinct()
    w = Window.partitionBy("system", "domain").orderBy("rank")
    return grades.withColumn("next_rank", F.lead("rank").over(w)).where(F.col("next_rank") - F.col("rank") <= max_gap)


def related_by_grade(standards: DataFrame, max_gap: int = 2) -> DataFrame:
    """``source_id, target_id, relationship, system``: all pairs of standards of consecutive grades, once each way."""
    steps = consecutive_grades(standards, max_gap)
    nodes = standards.select("id", "system", "domain", grade_rank(F.col("grade")).alias("rank")).distinct()
    low = nodes.join(steps, ["system", "domain", "rank"]).select(F.col("id").alias("lo"), "system", "domain", F.col("next_rank").alias("rank"))
    pairs = low.join(nodes, ["system", "domain", "rank"]).select("lo", F.col("id").alias("hi"), "system")
    return pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("source_id"), F.col("hi").alias("target_id"), F.lit("successor").alias("relationship"), "system"),
                F.struct(F.col("hi").alias("source_id"), F.col("lo").alias("target_id"), F.lit("prerequisite").alias("relationship"), "system"),
            )
        ).alias("e")
    ).select("e.*")


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge and its counterpart with the ends and the relationship swapped."""
    swap = F.when(F.col("relationship") == "prerequisite", "successor").when(F.col("relationship") == "successor", "prerequisite").otherwise(F.col("relationship"))
    back = edges.select(*(F.col("target_id").alias(c) if c == "source_id" else F.col("source_id").alias(c) if c == "target_id" else swap.alias(c) if c == "relationship" else F.col(c) for c in edges.columns))
    return edges.unionByName(back)


def prefer_validated(edges: DataFrame, validated: str) -> DataFrame:
    """Of each node and relationship the validated edges, or all where none is."""
    w = Window.partitionBy("source_id", "relationship")
    good = F.col("method") == validated
    return edges.withColumn("_any", F.max(F.when(good, 1).otherwise(0)).over(w)).where(good | (F.col("_any") == 0)).drop("_any")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int = 20) -> DataFrame:
    """``root, node, depth``: what each of ``starts`` (``root``) reaches over ``edges`` (``src, dst``) in at most ``max_depth`` steps, itself at depth 0.

    Cycles end where a node was seen. ``max_depth`` 0 gives the roots alone.
    """
    steps = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = cut(starts.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(steps, frontier["node"] == steps["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def prerequisites(edges: DataFrame, include_soft: bool = False) -> DataFrame:
    """``src, dst`` from a standard to its prerequisites, of edges that are confident enough."""
    floor = SOFT if include_soft else HARD
    return edges.where((F.col("relationship") == "prerequisite") & (F.col("confidence_score") >= floor) & ~F.isnan("confidence_score")).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def learning_path(edges: DataFrame, standards: DataFrame, targets: DataFrame, from_standards: DataFrame | None = None, max_depth: int = 20) -> DataFrame:
    """``root, step, id, grade, depth, prerequisites``: the closure of each target's prerequisites, by grade and id, the prerequisites
    within the path sorted. With ``from_standards`` (``root, start``) only what lies between the start and the target.

    Nodes that were not expanded, at ``max_depth``, have no prerequisites in the path; ids that are no standards are left out.
    """
    edges = cut(edges.distinct())
    seen = reachable(edges, targets, max_depth)
    inside = seen.where(F.col("depth") < max_depth).join(edges, F.col("node") == F.col("src")).select("root", "src", "dst")
    inside = inside.join(seen.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_semi")
    kept = seen
    if from_standards is not None:
        start = from_standards.select("root", F.col("start").alias("node")).join(seen.select("root", "node"), ["root", "node"], "left_semi")
        # forward from the start over reversed edges of one closure at a time: nodes are pairs of root and id
        pairs = inside.select(F.struct("root", F.col("dst").alias("id")).alias("src"), F.struct("root", F.col("src").alias("id")).alias("dst"))
        ahead = reachable(pairs, start.select(F.struct("root", F.col("node").alias("id")).alias("root")), max_depth)
        on_way = ahead.select(F.col("node.root").alias("root"), F.col("node.id").alias("node")).unionByName(targets.select("root", F.col("root").alias("node"))).distinct()
        kept = seen.join(on_way, ["root", "node"], "left_semi")
        inside = inside.join(kept.select("root", F.col("node").alias("src")), ["root", "src"], "left_semi").join(kept.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_semi")
    before = inside.groupBy("root", F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("prerequisites"))
    info = standards.select(F.col("id").alias("node"), "grade").groupBy("node").agg(F.min("grade").alias("grade"))
    w = Window.partitionBy("root").orderBy(grade_rank(F.col("grade")), "node")
    return (
        kept.join(info, "node")
        .join(before, ["root", "node"], "left")
        .select("root", F.row_number().over(w).alias("step"), F.col("node").alias("id"), "grade", "depth", F.coalesce("prerequisites", F.array().cast("array<string>")).alias("prerequisites"))
    )


def all_pairs_closure(edges: DataFrame) -> DataFrame:
    """``node, ancestor``: all ancestors of each node over ``src -> dst``; a node on a cycle is its own ancestor's descendant but never its own ancestor."""
    steps = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    known = steps.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"))
    new = known
    while not new.isEmpty():
        more = new.join(steps, F.col("ancestor") == F.col("src")).select("node", F.col("dst").alias("ancestor")).where("node <> ancestor").distinct()
        new = cut(more.join(known, ["node", "ancestor"], "left_anti"))
        known = cut(known.unionByName(new))
    return known


def contradicted(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """Edges (``src, dst``) that the reference has reversed and not as they are."""
    swapped = reference.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return edges.join(swapped, ["src", "dst"], "left_semi").join(reference.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def corroboration(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """``edges, direct, transitive, reversed, recalled, reference_edges``: how far two sets of ``src, dst`` agree."""
    ours, theirs = edges.select("src", "dst").distinct(), reference.select("src", "dst").distinct()
    closure = all_pairs_closure(theirs).select(F.col("node").alias("src"), F.col("ancestor").alias("dst"))

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("src", "dst").distinct().withColumn(name, F.lit(1))

    back = theirs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    j = ours.join(flag(theirs, "d"), ["src", "dst"], "left").join(flag(closure, "t"), ["src", "dst"], "left").join(flag(back, "r"), ["src", "dst"], "left")
    mine = j.agg(
        F.count("*").alias("edges"), F.count("d").alias("direct"), F.count("t").alias("transitive"), F.count_if(F.col("r").isNotNull() & F.col("d").isNull()).alias("reversed")
    )
    other = theirs.join(flag(ours, "o"), ["src", "dst"], "left").agg(F.count("*").alias("reference_edges"), F.count("o").alias("recalled"))
    return mine.join(other, F.lit(True))  # one row each


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of nodes, smaller first, that are each other's prerequisite."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").where("src < dst")


def promoted(edges: DataFrame, confirmed: DataFrame, against: DataFrame, by: str) -> DataFrame:
    """Soft edges that are confirmed and not contradicted, made hard: confidence and note rewritten, in both directions.

    ``confirmed`` and ``against`` have ``src, dst`` from a standard to its prerequisite.
    """
    pairs = confirmed.select("src", "dst").distinct().join(against.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("up", F.lit(True))
    e = edges.join(both, (F.col("source_id") == F.col("src")) & (F.col("target_id") == F.col("dst")), "left")
    rise = F.coalesce(F.col("up"), F.lit(False)) & (F.col("confidence_score") == SOFT)
    note = F.regexp_replace("notes", r"\bsoft\b(?:\s*\[[^\]]*\])?:", f"hard [promoted_soft_to_hard via {by}]:")
    return e.select(*(F.when(rise, F.lit(HARD)).otherwise(F.col(c)).alias(c) if c == "confidence_score" else F.when(rise, note).otherwise(F.col(c)).alias(c) if c == "notes" else F.col(c) for c in edges.columns))
