"""Exact nearest neighbours of 64-bit codes by incremental multi-index hashing.

A code is cut into segments; there are as many as make a segment's values about
as many as the codes (the width is log2 of their number, rounded down), at every
size.  Two codes at distance d agree within floor(d / segments) bits in some
segment, so looking up all values within radius r of the query's segments finds
everything up to distance segments * (r + 1) - 1.  The radius grows step by step;
a step is one join of all open queries' probes with all codes' segments by segment
and value.  A query stops when its k-th verified distance is within what is covered.

The join verifies: it only lets a pair through whose distance is not above the
query's k-th verified distance so far, as no other can enter, and which no earlier
step or segment has found.  Joins are sort-merge joins: a broadcast per step would
pile up on the driver.

Codes, not rows, are looked up: rows of equal codes keep their k + 1 smallest
ids, more cannot be among the k nearest.

Edge cases: null vectors, and vectors with a null value, take no part; a bit is
set where the value is above 0; fewer than k other rows give fewer neighbours;
ties go to the smaller id; rows of one id count as rows each; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpair.llm.common import stored
from textpair.session import shared_dir

BITS = 64
K = 10
QUERY_EVERY = 20
FOUND = "query long, distance int, first_id long, code long, n int, bound int"


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 values as bits of a long; null for null vectors."""
    bit = F.transform(
        vector, lambda v, i: F.when(v.isNull(), None).when(v > 0, F.expr("1L")).otherwise(F.lit(0).cast("long"))
    )
    code = F.aggregate(bit, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit("codes have at most 64 values"))).otherwise(code)


def segment_widths(total: int) -> list[int]:
    """Bits of each segment for so many codes: about log2 of their number, and all bits in equal shares."""
    count = min(BITS, ceil(BITS / max(1.0, log2(max(total, 1)))))
    return [BITS // count + (i < BITS % count) for i in range(count)]


def segment(code: Column, number: int, widths: list[int]) -> Column:
    start = sum(widths[:number])
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << widths[number]) - 1).cast("long"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def flips(width: int, radius: int) -> Column:
    """All values of so many bits with ``radius`` ones, as one constant array."""
    values = (sum(1 << b for b in bits) for bits in combinations(range(width), radius))
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Per query code the k + 1 nearest codes, and the distance within which it has k + 1 ids (``BITS`` + 1: nowhere yet)."""
    order = Window.partitionBy("query").orderBy("distance", "first_id")
    placed = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1)
    ids = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    reached = placed.withColumn("_reached", F.when(ids >= k + 1, F.col("distance")))
    bound = F.coalesce(F.min("_reached").over(Window.partitionBy("query")), F.lit(BITS + 1))
    return reached.select("query", "distance", "first_id", "code", "n", bound.cast("int").alias("bound"))


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the k nearest other rows of every query row.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` tells the queries.
    """
    spark = vectors.sparkSession
    rows = stored(
        vectors.where("vec_id IS NOT NULL")
        .select("vec_id", sign_code(F.col("embedding")).alias("code"), is_query.alias("asks")).where("code IS NOT NULL"),
        "codes",
    )
    # Rows are reduced per code and id place, so a code of any number of rows stays small.
    place = Window.partitionBy("code").orderBy("vec_id")
    codes = stored(
        rows.select("code", "vec_id", F.row_number().over(place).alias("_place")).where(F.col("_place") <= k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("first_id", F.element_at("ids", 1)),
        "distinct-codes",
    )
    widths = segment_widths(codes.count())
    numbers = range(len(widths))
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), segment(F.col("code"), i, widths).alias("value")) for i in numbers]))
    index = stored(codes.select("code", "first_id", F.size("ids").alias("n"), parts.alias("_p")).select("*", "_p.*").drop("_p"), "segments")
    active = stored(rows.where("asks").select(F.col("code").alias("query"), F.lit(BITS + 1).alias("bound")).distinct(), "queries")
    best = spark.createDataFrame([], FOUND)
    finished = shared_dir(spark, "neighbours")
    for radius in range(max(widths) + 1):
        covered = len(widths) * (radius + 1) - 1
        found = looked_up(active, index, widths, radius).withColumn("bound", F.lit(0))
        best = stored(ranked(best.unionByName(found), k), "best")
        done = F.col("bound") <= covered
        best.where(done).write.mode("append").parquet(finished)
        bounds = best.select("query", F.col("bound").alias("_bound")).distinct()
        known = active.join(bounds.hint("merge"), "query", "left").select("query", F.coalesce("_bound", "bound").alias("bound"))
        active = stored(known.where(~done), "queries")
        best = best.where(~done)
        if active.isEmpty():
            break
    else:
        # Every distance is covered: these queries have fewer than k others.
        best.write.mode("append").parquet(finished)
    return expanded(rows, codes, spark.read.schema(FOUND).parquet(finished), k)


def looked_up(active: DataFrame, index: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """Pairs within the query's bound that some segment finds at this radius, each from the first segment that does.

    Earlier radii have found what is nearer than the radius in any segment.
    """
    numbers = range(len(widths))
    parts = F.array(*[
        F.struct(F.lit(i).alias("part"), segment(F.col("query"), i, widths).alias("value"), F.lit(widths[i]).alias("width"))
        for i in numbers
    ])
    masks = F.array().cast("array<bigint>")
    for width in sorted(set(widths)):
        masks = F.when(F.col("_p.width") == width, flips(width, radius) if radius <= width else F.array().cast("array<bigint>")).otherwise(masks)
    probes = active.select("query", "bound", F.explode(parts).alias("_p")).select(
        "query", "bound", F.col("_p.part").alias("part"), F.col("_p.value").alias("_own"), F.explode(masks).alias("_mask")
    ).select("query", "bound", "part", F.col("_own").bitwiseXOR(F.col("_mask")).alias("value"))
    apart = distance(F.col("query"), F.col("code"))
    fresh = F.lit(True)
    for i in numbers:
        far = distance(segment(F.col("query"), i, widths), segment(F.col("code"), i, widths))
        fresh = fresh & (far >= F.when(F.col("_part") > i, radius + 1).when(F.col("_part") < i, radius).otherwise(0))
    target = index.withColumnRenamed("part", "_part").withColumnRenamed("value", "_value")
    match = (F.col("part") == F.col("_part")) & (F.col("value") == F.col("_value")) & (apart <= F.col("bound")) & fresh
    pairs = probes.join(target.hint("merge"), match)
    return pairs.select("query", apart.cast("int").alias("distance"), "first_id", "code", "n")


def expanded(rows: DataFrame, codes: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """From pairs of codes to neighbours of rows."""
    ids = found.select("query", "distance", "code").join(codes.select("code", "ids").hint("merge"), "code")
    near = ids.select("query", "distance", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy("distance", "vec_id")
    near = near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1)
    lists = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("_near"))
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
    others = F.slice(F.filter("_near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    listed = asking.join(lists.hint("merge"), "query").select("query_id", F.posexplode(others).alias("rank", "_one"))
    return listed.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("_one.vec_id").alias("vec_id"), F.col("_one.distance").alias("distance"))
