"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, sized, stored
from .substrings import release


def _stars(rows: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: one grouping."""
    end = lambda c, own, other: F.struct(F.col(c).alias("node"), F.lit(own).alias("own"), F.lit(other).alias("other"))
    ends = rows.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("other").alias("other")).where("own > 1 OR (own = 1 AND other = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that is reachable.

    Edges are two long columns in any order, repeats and loops included; an edge with a null end is ignored, an empty
    table gives no row.  Each round is two grouped minima and their joins, written to the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    rows = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    rows = stored(rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    count = rows.count()  # no round makes more edges
    while not _stars(rows):
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(apart(low, count), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low, count), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = stored(sized(small.where("u <> v").distinct(), count), "edges")
        discard(rows)
        rows = new
        release(rows.sparkSession)  # a round's plans are garbage that the driver's heap would grow by
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
