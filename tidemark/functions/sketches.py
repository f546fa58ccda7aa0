"""Mergeable sketches as relations: Count-Min, HyperLogLog and Bloom.

A sketch is a small table of fixed size (depth x width cells, 2^p registers, at most m positions),
whatever the input. Rows are hashed where they are and combined by cell, register or position before
the one shuffle, which is therefore of the sketch's size for each partition, not of the items'.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import hash32, hashes


def count_min(df: DataFrame, item: str, depth: int = 5, width: int = 2000, by: list[str] | tuple = (), weight: Column | None = None) -> DataFrame:
    """(*by, row, col, n): cell (row, hash32(item, row) mod width) holds the sum of its items' counts."""
    items = df.select(*by, F.col(item).alias("item"), (F.lit(1).cast("long") if weight is None else weight).alias("n"))
    cells = _cells(items, "item", depth, width)
    return cells.groupBy(*by, "row", "col").agg(F.sum("n").alias("n"))


def _cells(df: DataFrame, item: str, depth: int, width: int) -> DataFrame:
    """Adds an item's cells, one row each: the row is the seed of its hash."""
    cells = hashes(F.col(item), F.lit(list(range(depth))), lambda row, h: F.struct(row.alias("row"), (h % width).alias("col")))
    return df.withColumn("_cell", F.explode(cells)).select("*", "_cell.row", "_cell.col").drop("_cell")


def count_min_merge(grids: DataFrame, *more: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Cell-wise sum of grids of one shape. One grid with more key columns merges over those not in `by`."""
    for grid in more:
        grids = grids.unionByName(grid)
    return grids.groupBy(*by, "row", "col").agg(F.sum("n").alias("n"))


def count_min_estimate(grid: DataFrame, items: DataFrame, item: str, depth: int = 5, width: int = 2000, by: list[str] | tuple = ()) -> DataFrame:
    """(*by, item, estimate): the least of an item's cells, 0 where a cell is empty. Never below the true count."""
    probes = items.select(*by, item).distinct()
    probes = _cells(probes, item, depth, width)
    found = probes.join(grid, [*by, "row", "col"], "left")
    return found.groupBy(*by, item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def count_min_bytes(depth: int, width: int) -> int:
    return depth * width * 4


def grids_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (equal): whether two grids agree in every cell, an absent cell counting as 0."""
    both = left.select("row", "col", F.col("n").alias("a")).join(right.select("row", "col", F.col("n").alias("b")), ["row", "col"], "full")
    return both.agg((F.sum((F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))).cast("int"))).alias("x")).select((F.coalesce("x", F.lit(0)) == 0).alias("equal"))


def hll_registers(df: DataFrame, item: str, p: int = 12, by: list[str] | tuple = ()) -> DataFrame:
    """(*by, register, rank): top p bits choose the register, which keeps the most leading zeros of the rest, plus one."""
    hashed = df.select(*by, hash32(F.col(item)).alias("h"))
    rest = F.shiftleft("h", p).bitwiseOR(1 << (p - 1)).bitwiseAND(4294967295)
    rank = (F.lit(33) - F.length(F.bin(rest))).cast("int")
    return hashed.groupBy(*by, F.shiftrightunsigned("h", 32 - p).alias("register")).agg(F.max(rank).alias("rank"))


def hll_merge(registers: DataFrame, *more: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    for other in more:
        registers = registers.unionByName(other)
    return registers.groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int = 12, by: list[str] | tuple = ()) -> DataFrame:
    """(*by, estimate): raw estimate, or linear counting while small and some register is empty; rounded."""
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = registers.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("filled"))
    empty = F.lit(m) - F.col("filled")
    raw = F.lit(alpha * m * m) / (F.col("s") + empty)
    counted = F.when((raw <= 2.5 * m) & (empty > 0), F.lit(float(m)) * F.log(F.lit(float(m)) / empty)).otherwise(raw)
    return sums.select(*by, F.floor(counted + 0.5).cast("long").alias("estimate"))


def _bloom_positions(item: Column, m: int, k: int) -> Column:
    pair = F.array(hashes(item, F.lit([1, 2]), lambda _, h: h))
    return F.flatten(F.transform(pair, lambda h: F.array(*[(h[0] + F.lit(i) * h[1]) % m for i in range(k)])))


def bloom_bits(df: DataFrame, item: str, m: int = 100_000, k: int = 7) -> DataFrame:
    """(position): the set bits. Merging filters is the distinct union."""
    return df.select(F.col(item).alias("item")).select(F.explode(_bloom_positions(F.col("item"), m, k)).alias("position")).distinct()


def bloom_test(bits: DataFrame, items: DataFrame, item: str, m: int = 100_000, k: int = 7) -> DataFrame:
    """(item, maybe): true if all k bits of an item are set; false is certain."""
    probes = items.select(item).distinct().select(item, F.explode(_bloom_positions(F.col(item), m, k)).alias("position"))
    found = probes.join(bits.withColumn("hit", F.lit(True)), "position", "left")
    return found.groupBy(item).agg(F.min(F.coalesce("hit", F.lit(False))).alias("maybe"))


def bloom_false_positive_rate(n: int, m: int, k: int) -> float:
    return (1 - math.exp(-k * n / m)) ** k


def relative_error(estimate: Column, exact: Column) -> Column:
    return (estimate - exact) / exact
