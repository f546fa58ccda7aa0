"""Running aggregates over a total order, without one partition that holds all rows.

Rows fall into runs, ranges of the order cut from the data itself, so that runs are about equal whatever
its values are. Each run is scanned by a window of its own, and what the runs before it give is added
from a table of one row a run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a run, and runs at most (beyond, runs grow with the data).
RUN, MOST = 8192, 4096


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores before them as the frame's columns leave free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def runs(df: DataFrame, order: str, rows: int = RUN, most: int = MOST) -> Column:
    """Number of a row's run: it grows with the order, and equal values share one.

    The rows are counted, then the order's quantiles taken, a number a run (most at most reach the driver);
    a row finds its run among them by halving. Values that repeat more than a run's rows make their run larger.
    """
    n = min(most, math.ceil(df.count() / rows))
    found = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], max(1_000, 10 * n))).first()[0] if n > 1 else None
    if not found:
        return F.lit(0)
    bounds = sorted(set(found))
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    table = F.array(*map(F.lit, bounds))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.col(order), at + step).otherwise(at))


def running_max(df: DataFrame, value: Column, order: list[str], out: str, inclusive: bool = True, by: list[str] | tuple = (), rows: int = RUN) -> DataFrame:
    """Adds `out`: the greatest value up to a row (or before it), null where there is none."""
    v, run, inner, most = fresh(df, "_v", "_run", "_inner", "_most")
    runned = df.withColumns({v: value, run: runs(df, order[0], rows)})
    end = Window.currentRow if inclusive else -1
    window = Window.partitionBy(*by, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    ends = runned.groupBy(*by, run).agg(F.max(v).alias(most))
    before = Window.partitionBy(*by).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, run, F.max(most).over(before).alias(most))
    scanned = runned.withColumn(inner, F.max(v).over(window)).join(ends, [*by, run])
    return scanned.select(*df.columns, F.greatest(inner, most).alias(out))


def running_last(df: DataFrame, value: Column, order: list[str], out: str, by: list[str] | tuple = (), rows: int = RUN) -> DataFrame:
    """Adds `out`: the last value up to a row that is not null."""
    v, run, inner, last = fresh(df, "_v", "_run", "_inner", "_last")
    runned = df.withColumns({v: value, run: runs(df, order[0], rows)})
    window = Window.partitionBy(*by, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = runned.groupBy(*by, run).agg(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(last))
    before = Window.partitionBy(*by).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, run, F.last(last, ignorenulls=True).over(before).alias(last))
    scanned = runned.withColumn(inner, F.last(v, ignorenulls=True).over(window)).join(ends, [*by, run])
    return scanned.select(*df.columns, F.coalesce(inner, last).alias(out))


def running_count(df: DataFrame, order: str, out: str, by: list[str], rows: int = RUN) -> DataFrame:
    """Adds `out`: the number of rows of a key up to a row. A hot key's rows are spread over its runs."""
    run, inner, before_, n = fresh(df, "_run", "_inner", "_before", "_n")
    runned = df.withColumn(run, runs(df, order, rows))
    ends = runned.groupBy(*by, run).agg(F.count("*").alias(n))
    before = Window.partitionBy(*by).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, run, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(before_))
    scanned = runned.withColumn(inner, F.count("*").over(Window.partitionBy(*by, run).orderBy(order))).join(ends, [*by, run])
    return scanned.select(*df.columns, (F.col(inner) + F.col(before_)).alias(out))


def lagged(df: DataFrame, value: Column, order: list[str], out: str, by: list[str], rows: int = RUN) -> DataFrame:
    """Adds `out`: the value of the key's row before, null where there is none; nulls count as values."""
    v, run, inner, last = fresh(df, "_v", "_run", "_inner", "_last")
    runned = df.withColumns({v: F.struct(value.alias("v")), run: runs(df, order[0], rows)})
    ends = runned.groupBy(*by, run).agg(F.max_by(v, F.struct(*order)).alias(last))
    ends = ends.select(*by, run, F.lag(last).over(Window.partitionBy(*by).orderBy(run)).alias(last))
    scanned = runned.withColumn(inner, F.lag(v).over(Window.partitionBy(*by, run).orderBy(*order))).join(ends, [*by, run])
    return scanned.select(*df.columns, F.coalesce(inner, last)["v"].alias(out))
