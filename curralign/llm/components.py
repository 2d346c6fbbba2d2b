"""Consolidating pairwise matches into groups: deterministic Borůvka hooking.

In every round each component selects its smallest outgoing edge, edges being ordered by (smaller end, larger end); for a
component that is the edge to its smallest neighbour. The selected edges form trees whose only cycles are mutual
choices, which the smaller end wins. Pointer doubling collapses the trees, edges are relabelled and deduplicated, and
the rounds end when no edge is left. A component at least doubles in each round, so there are at most log2(n) rounds.

A vertex with very many edges loses them all in the first round, since each of its leaves hooks onto something; the
minimum over its neighbours is aggregated before the shuffle, and relabelling joins on a key that is unique on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut


def _collapse(parent: DataFrame) -> DataFrame:
    """Pointer doubling on ``v, p`` until every ``p`` is a root, three doublings at a time. Roots point at themselves."""
    while True:
        now = parent.withColumn("was", F.col("p"))
        for _ in range(3):
            up = now.select(F.col("v").alias("p"), F.col("p").alias("q"))
            now = now.select("v", "p").join(up, "p").select("v", F.col("p").alias("was"), F.col("q").alias("p"))
        now = cut(now)
        parent = now.select("v", "p")
        if now.where("p <> was").isEmpty():
            return parent


def boruvka_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``id, group_id``: every id of ``pairs`` that is linked to another one, and the smallest id of its group.

    Null ends and self-pairs link nothing; repeated and mirrored pairs count once; ids are compared exactly. An id that
    occurs only in such pairs gives no row. An empty frame gives an empty result. The ids may be strings or numbers.
    """
    edges = (
        pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
        .where("ok and x <> y")
        .select("x", "y")
        .distinct()
    )
    edges = cut(edges)
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("x").alias("v"), F.col("y").alias("w")).unionAll(edges.select("y", "x"))
        hook = both.groupBy("v").agg(F.min("w").alias("p"))
        back = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
        mutual = (F.col("q") == F.col("v")) & (F.col("v") < F.col("p"))
        tree = hook.join(back, "p").select("v", F.when(mutual, F.col("v")).otherwise(F.col("p")).alias("p"))
        root = _collapse(tree)
        moves.append(root)
        rx, ry = root.select(F.col("v").alias("x"), F.col("p").alias("rx")), root.select(F.col("v").alias("y"), F.col("p").alias("ry"))
        edges = cut(
            edges.join(rx, "x")
            .join(ry, "y")
            .where("rx <> ry")
            .select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"))
            .distinct()
        )
    if not moves:
        kind = dict(edges.dtypes)["x"]
        return edges.select(F.col("x").cast(kind).alias("id"), F.col("y").cast(kind).alias("group_id")).limit(0)
    labels = moves[0].select(F.col("v").alias("id"), F.col("p").alias("g"))
    for root in moves[1:]:  # at most log2(n) of them
        move = root.select(F.col("v").alias("g"), F.col("p").alias("to"))
        labels = labels.join(move, "g", "left").select("id", F.coalesce("to", "g").alias("g"))
    smallest = labels.groupBy("g").agg(F.min("id").alias("group_id"))
    return labels.join(smallest, "g").select("id", "group_id")


def match_groups(crosswalks: DataFrame) -> DataFrame:
    """``standard_id, group_id`` over the valid matches: latest delivery, ``equivalent`` in any case and with outer blanks, unflagged, both ids neither null nor blank."""
    from .topn import latest_delivery

    latest = latest_delivery(crosswalks, "id", "updated_at", ["source_id", "target_id", "relationship", "flagged_for_review"])
    matches = latest.where("lower(trim(relationship)) = 'equivalent' and flagged_for_review = 0 and trim(source_id) <> '' and trim(target_id) <> ''")
    return boruvka_components(matches, "source_id", "target_id").withColumnRenamed("id", "standard_id")
