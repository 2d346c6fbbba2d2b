"""References to records that do not exist.

A Bloom filter over the parent keys travels with the tasks. A reference that the filter rejects is a proven orphan; only
references that it lets through are verified by an exact join. The filter's size is bounded by
``max_bits`` (8 MB by default), whatever the number of parents: with more parents the share of false positives grows, and
with it the exact join, but never the broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest filter, in bits.
MAX_BITS = 67_108_864
BITS_PER_KEY = 10


@dataclass(frozen=True)
class BloomFilter:
    """Filter of the values of one string column: a frame of one row and one column, null for no keys at all.

    Plans ask it as a scalar subquery. As a literal its hexadecimal digits would stand in every text of a plan that the driver keeps.
    """

    one: DataFrame

    def might_contain(self, col: Column) -> Column:
        """False only for values that were certainly not among the keys. The value is hashed as a string."""
        from pyspark import SparkContext
        from pyspark.sql.classic.column import Column as ClassicColumn

        jvm = SparkContext._active_spark_context._jvm
        to = jvm.org.apache.spark.sql.classic.ExpressionUtils
        test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
            to.expression(self.one.scalar()._jc), to.expression(F.xxhash64(col.cast("string"))._jc)
        )
        return F.coalesce(ClassicColumn(to.column(test)), F.lit(False))


def bloom_filter(df: DataFrame, key: str, max_bits: int = MAX_BITS) -> BloomFilter:
    """A Bloom filter of ``df[key]``: one partial aggregate per task, merged to at most ``max_bits`` bits."""
    from pyspark.sql.internal import InternalFunction

    keys = df.select(F.col(key).cast("string").alias("k")).where("k is not null")
    n = max(1, keys.count())
    bits = min(max(1024, n * BITS_PER_KEY), max_bits)
    agg = InternalFunction._invoke_internal_function_over_columns(
        "bloom_filter_agg", F.xxhash64("k"), F.lit(int(n)).cast("long"), F.lit(int(bits)).cast("long")
    )
    return BloomFilter(keys.agg(agg.alias("b")))


def find_orphans(refs: DataFrame, parents: DataFrame, retired: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """References whose parent is missing, was deleted or came later.

    ``refs``: columns ``tbl``, ``fld``, ``row_key``, ``ref`` (strings) and ``created_at``; ``parents``: ``id``,
    ``created_at``; ``retired``: ``id``. Null and blank references are no references and give no row. Copies of a row
    count once. Result: ``tbl, fld, row_key, period, kind``; ``period`` is ``yyyy-MM`` of the reference or ``unknown``
    for a null time, which is never late. ``kind``: ``deleted`` (in ``retired`` only), ``missing`` (in neither), ``late``
    (the parent came after the reference; with copies of a parent the earliest counts). Empty tables give no rows or,
    for an empty ``parents``, only ``deleted`` and ``missing``. Extra columns are ignored.
    """
    refs = refs.select("tbl", "fld", "row_key", "ref", "created_at").where("trim(ref) <> ''")
    known = bloom_filter(parents, "id", max_bits)
    period = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown"))
    tested = refs.withColumn("maybe", known.might_contain(F.col("ref")))
    parent = parents.where("id is not null").groupBy("id").agg(F.min("created_at").alias("born"))
    verified = (
        tested.where("maybe")
        .join(parent, F.col("ref") == parent["id"], "left")
        .where(F.col("id").isNull() | (F.col("created_at") < F.col("born")))
        .select("tbl", "fld", "row_key", "ref", period.alias("period"), F.col("id").isNotNull().alias("late"))
    )
    proven = tested.where("not maybe").select("tbl", "fld", "row_key", "ref", period.alias("period"), F.lit(False).alias("late"))
    gone = retired.where("id is not null").select(F.col("id").alias("ref")).distinct().withColumn("gone", F.lit(True))
    kind = F.when(F.col("late"), "late").when(F.col("gone"), "deleted").otherwise("missing")
    return (
        verified.unionByName(proven)
        .join(gone, "ref", "left")
        .select("tbl", "fld", "row_key", "period", kind.alias("kind"))
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Number of orphan references by table, field, month and kind."""
    return found.groupBy("tbl", "fld", "period", "kind").agg(F.count("*").alias("n"))


def reference_fields(crosswalks: DataFrame, edges: DataFrame, subs: DataFrame) -> DataFrame:
    """The four reference fields of the curriculum tables as one frame for :func:`find_orphans`."""

    def part(df: DataFrame, tbl: str, *fields: str) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f).alias("ref")) for f in fields)))
        return df.select(F.lit(tbl).alias("tbl"), F.col("id").cast("string").alias("row_key"), "created_at", pairs.alias("x")).select(
            "tbl", "x.fld", "row_key", "x.ref", "created_at"
        )

    return (
        part(crosswalks, "crosswalk_mappings", "target_id")
        .unionByName(part(edges, "standard_relationships", "source_id", "target_id"))
        .unionByName(part(subs, "sub_standards", "parent_id"))
    )
