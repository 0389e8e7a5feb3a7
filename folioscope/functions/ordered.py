"""Running values along an order within a key, without one task holding a whole key.

A window over a key runs in one task, which is no way to treat a key that has a third of all rows.
Here each key is cut into buckets along its order: totals of buckets are aggregated, a small window
runs over those, and the rows' own window runs within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 20_000


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], bucket: int = BUCKET) -> DataFrame:
    """df with a column for each of values, name: (kind, column).

    kinds: sum, min, last (the last that isn't null) up to and with each row, prev (that of the row
    before, null for the first), next (of the row after). The first column of order is a number that
    is dense enough to cut by; nulls in it count as 0.
    """
    b = df.withColumn("_b", F.floor(F.coalesce(F.col(order[0]), F.lit(0)) / bucket))
    place = [F.col(c) for c in order]
    total = {
        "sum": lambda c: F.sum(c),
        "min": lambda c: F.min(c),
        "last": lambda c: F.max(F.when(c.isNotNull(), F.struct(*place, c.alias("_v"))))["_v"],
        "prev": lambda c: F.max(F.struct(*place, c.alias("_v")))["_v"],
        "next": lambda c: F.min(F.struct(*place, c.alias("_v")))["_v"],
    }
    t = b.groupBy(*keys, "_b").agg(*[total[kind](c).alias(f"_t_{n}") for n, (kind, c) in values.items()])
    over = Window.partitionBy(*keys).orderBy("_b")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        "sum": lambda n: F.sum(n).over(before),
        "min": lambda n: F.min(n).over(before),
        "last": lambda n: F.last(n, True).over(before),
        "prev": lambda n: F.lag(n).over(over),
        "next": lambda n: F.lead(n).over(over),
    }
    t = t.select(*keys, "_b", *[carried[kind](f"_t_{n}").alias(f"_c_{n}") for n, (kind, _) in values.items()])
    j = b.join(t, [*keys, "_b"])
    rows = Window.partitionBy(*keys, "_b").orderBy(*order)
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    first, last = F.row_number().over(rows) == 1, F.lead(F.lit(1)).over(rows).isNull()
    own = {
        "sum": lambda n, c: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)),
        "min": lambda n, c: F.least(F.min(c).over(upto), F.col(f"_c_{n}")),
        "last": lambda n, c: F.coalesce(F.last(c, True).over(upto), F.col(f"_c_{n}")),
        "prev": lambda n, c: F.when(first, F.col(f"_c_{n}")).otherwise(F.lag(c).over(rows)),
        "next": lambda n, c: F.when(last, F.col(f"_c_{n}")).otherwise(F.lead(c).over(rows)),
    }
    return j.select(*[f"`{c}`" for c in df.columns], *[own[kind](n, c).alias(n) for n, (kind, c) in values.items()])
