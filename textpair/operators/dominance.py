"""How many outputs of one model each output of another beats, without listing the pairs.

Outputs meet per target; one beats another if all its scores are higher.  Few
outputs per target are joined.  The outputs of a target with many are
dealt to tiles of about ``TILE`` by ``TILE`` distinct score rows, and a tile is counted with
bitmaps: for each score, the outputs below a rank are one row of bits, so the outputs
beaten are the AND of four rows and their number is a count of bits.  Copies of
score rows count by the bits of their multiplicity.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpair.functions.rouge import SCORE_COLUMNS
from textpair.operators.compare import _number, counted_sides

# Distinct score rows of one model in a tile, and the pairs of a target up to which a join is cheaper.
TILE = 8192
FEW_PAIRS = 4096
# Rows of bits looked up at once.
CHUNK = 1024


def beaten(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For every row of scores in ``a``: how many rows of ``b``, each counted ``times`` times, are lower in all columns."""
    wins = np.zeros(len(a), np.int64)
    if not len(a) or not len(b):
        return wins
    # The outputs in one order; bits of their multiplicities.
    planes = [
        (k, np.packbits((times >> k) & 1 == 1)) for k in range(int(times.max()).bit_length()) if ((times >> k) & 1).any()
    ]
    below, ranks = [], []
    for c in range(a.shape[1]):
        order = np.argsort(b[:, c], kind="stable")
        ranks.append(np.searchsorted(b[order, c], a[:, c], side="left"))
        # Row r: the r lowest outputs of this score.  Only ranks that are asked for get a row.
        asked, place = np.unique(ranks[-1], return_inverse=True)
        height = np.empty(len(b), np.int64)
        height[order] = np.arange(len(b))
        table = np.empty((len(asked), (len(b) + 7) // 8), np.uint8)
        for start in range(0, len(asked), CHUNK):
            part = asked[start : start + CHUNK]
            table[start : start + CHUNK] = np.packbits(height[None, :] < part[:, None], axis=1)
        below.append(table)
        ranks[-1] = place
    for start in range(0, len(a), CHUNK):
        rows = slice(start, start + CHUNK)
        bits = below[0][ranks[0][rows]]
        for table, rank in zip(below[1:], ranks[1:], strict=True):
            bits &= table[rank[rows]]
        for k, plane in planes:
            wins[rows] += np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64) << k
    return wins


def _tile(a: pa.Table, b: pa.Table) -> pa.Table:
    def scores(table: pa.Table, name: str) -> np.ndarray:
        return np.stack([table[f"{name}_{c}"].to_numpy() for c in SCORE_COLUMNS], axis=1) if len(table) else np.zeros((0, len(SCORE_COLUMNS)))

    times = b["b_n"].to_numpy() if len(b) else np.zeros(0, np.int64)
    wins = beaten(scores(a, "a"), scores(b, "b"), times)
    kept = [n for n in a.column_names if n not in ("_ia", "_ib")]
    return pa.table([*(a[n] for n in kept), pa.array(wins)], names=[*kept, "wins"])


def outperformed_counts(
    df: DataFrame, first: str, second: str, null_safe: bool = True, on: Sequence[str] = ("target_query",)
) -> DataFrame:
    """``(*on, generated_output, n, wins)``: outputs of ``first`` that beat an output of ``second`` on all four scores.

    ``n`` is how often the output occurs for its target, ``wins`` the number of rows of ``second`` with that target
    that each of them beats.  Outputs that beat none are left out; a missing score never wins or loses.
    """
    on = list(on)

    rows = df.where(F.col("model").isin(first, second))
    for c in SCORE_COLUMNS:
        # The plain test is what joins would add on one side alone, which would then have a plan of its own.
        rows = rows.where(F.col(c).isNotNull() & _number(c).isNotNull())
    rows = rows if null_safe else rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on))
    sides = counted_sides(rows, (first, second), [*on, "generated_output", *SCORE_COLUMNS])

    def named(side: DataFrame, name: str) -> DataFrame:
        keys = [F.col(k).alias(f"{name}_{k}") for k in on]
        return side.select(*keys, "generated_output", *[F.col(c).alias(f"{name}_{c}") for c in SCORE_COLUMNS], "n")

    def same(left: str, right: str) -> Column:
        match = F.lit(True)
        for k in on:
            match = match & F.col(f"{left}_{k}").eqNullSafe(F.col(f"{right}_{k}"))
        return match

    outputs, b_rows = named(sides[0], "a"), named(sides[1], "b")
    a_keys, b_keys = [f"a_{k}" for k in on], [f"b_{k}" for k in on]
    a_scores, b_scores = [f"a_{c}" for c in SCORE_COLUMNS], [f"b_{c}" for c in SCORE_COLUMNS]
    a = outputs.select(*a_keys, *a_scores).distinct()
    b = b_rows.groupBy(*b_keys, *b_scores).agg(F.sum("n").alias("b_n"))
    sizes = a.groupBy(*[F.col(k).alias(k.replace("a_", "s_", 1)) for k in a_keys]).agg(F.count(F.lit(1)).alias("_na")).join(
        b.groupBy(*b_keys).agg(F.count(F.lit(1)).alias("_nb")), same("s", "b")
    ).drop(*b_keys)
    a_sized = a.join(sizes, same("a", "s")).drop(*[f"s_{k}" for k in on])
    b_sized = b.join(sizes, same("b", "s")).drop(*[f"s_{k}" for k in on])
    few = F.col("_na") * F.col("_nb") <= FEW_PAIRS

    higher = F.lit(True)
    for x, y in zip(a_scores, b_scores, strict=True):
        higher = higher & (F.col(x) > F.col(y))
    joined = (
        a_sized.where(few).drop("_na", "_nb").join(b_sized.where(few).drop("_na", "_nb"), same("a", "b") & higher)
        .groupBy(*a_keys, *a_scores).agg(F.sum("b_n").alias("wins"))
    )

    def block(scores: list[str], n: str) -> Column:
        return F.pmod(F.xxhash64(*scores), F.ceil(F.col(n) / TILE)).cast("int")

    def blocks(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / TILE).cast("int") - 1))

    a_tiles = a_sized.where(~few).select(*a_keys, *a_scores, block(a_scores, "_na").alias("_ia"), blocks("_nb").alias("_ib"))
    b_tiles = b_sized.where(~few).select(*b_keys, *b_scores, "b_n", blocks("_na").alias("_ia"), block(b_scores, "_nb").alias("_ib"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema.fields) + ", wins long"
    tiled = (
        a_tiles.groupBy(*a_keys, "_ia", "_ib").cogroup(b_tiles.groupBy(*b_keys, "_ia", "_ib")).applyInArrow(_tile, schema)
        .groupBy(*a_keys, *a_scores).agg(F.sum("wins").alias("wins"))
    )
    wins = joined.unionByName(tiled).where("wins > 0").select(
        *[F.col(c).alias(c.replace("a_", "w_", 1)) for c in [*a_keys, *a_scores]], "wins"
    )
    match = same("a", "w")
    for c in SCORE_COLUMNS:
        match = match & (F.col(f"a_{c}") == F.col(f"w_{c}"))
    return outputs.join(wins, match).select(*[F.col(f"a_{k}").alias(k) for k in on], "generated_output", "n", "wins")
