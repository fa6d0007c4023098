"""Interval and as-of joins: which spans touch which, and what stands last before a place.

Both cut positions into blocks, so that the work on one long document is shared by many tasks: rows meet by key and
block, never all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, on: list[str], *, ends: tuple[str, str] = ("start", "end"), right_ends: tuple[str, str] = ("from", "to"), width: int = 2000) -> DataFrame:
    """All pairs of rows with equal ``on`` whose closed intervals share a point.

    An interval goes to every block of ``width`` positions that it reaches; a pair meets in all blocks that both reach
    and counts in the one that holds the larger of its two starts, so no pair is made twice and none is lost.  Intervals
    that end before they start, or have no place, touch nothing.
    """
    lo, hi, from_, to = (F.col(c) for c in (*ends, *right_ends))

    def blocks(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))

    names = {c: f"__{c}" for c in on}
    right = right.where(from_ <= to).select(*(F.col(c).alias(names.get(c, c)) for c in right.columns), blocks(from_, to).alias("__there"))
    left = left.where(lo <= hi).withColumn("__here", blocks(lo, hi))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    met = left.join(right, [*same, F.col("__here") == F.col("__there")]).where((lo <= to) & (from_ <= hi) & (F.floor(F.greatest(lo, from_) / width) == F.col("__here")))
    return met.drop("__here", "__there", *names.values())


def last_before(points: DataFrame, marks: DataFrame, on: list[str], *, at: str = "at", mark_at: str = "mark_at", mark: str = "mark", strict: bool = True, width: int = 100_000) -> DataFrame:
    """``points`` with ``mark``: of the marks with equal ``on``, the last one before (``strict``) or up to the point; null if there is none.

    Of several marks at one place the greatest counts.  Within a block of ``width`` positions a running last value over
    points and marks in order gives it; what a block does not hold itself comes from the last mark of the blocks
    before, of which one row each is compared.
    """
    block = lambda c: F.floor(F.col(c) / width)
    kind = marks.schema[mark].dataType
    best = marks.where(F.col(mark_at).isNotNull()).groupBy(*on, F.col(mark_at).alias("__at")).agg(F.max(mark).alias("__mark")).withColumn("__block", block("__at"))
    rows = points.select(*on, F.struct(*points.columns).alias("__row"), F.col(at).alias("__at"), block(at).alias("__block"), F.lit(None).cast(kind).alias("__mark"), F.lit(True).alias("__point"))
    known = best.select(*on, F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "__at", "__block", F.struct("__mark").alias("__held"), F.lit(False).alias("__point"))
    held = F.lit(None).cast(known.schema["__held"].dataType)
    both = rows.drop("__mark").withColumn("__held", held).unionByName(known)
    # at one place: marks first if they count for its points, else points first
    order = Window.partitionBy(*on, "__block").orderBy("__at", F.col("__point") if not strict else ~F.col("__point"))
    inside = both.withColumn("__in", F.last("__held", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__point")
    lasts = best.groupBy(*on, "__block").agg(F.max_by(F.struct("__mark"), F.col("__at")).alias("__held"))
    asked = rows.select(*on, "__block").distinct().withColumn("__held", held).withColumn("__ask", F.lit(1))
    chain = lasts.withColumn("__ask", F.lit(0)).unionByName(asked)
    upto = Window.partitionBy(*on).orderBy("__block", F.col("__ask").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = chain.withColumn("__before", F.last("__held", ignorenulls=True).over(upto)).where("__ask = 1").select(*(F.col(c).alias(f"__{c}") for c in on), F.col("__block").alias("__b"), "__before")
    joined = inside.join(before, [*(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on), F.col("__block").eqNullSafe(F.col("__b"))], "left")
    return joined.select("__row.*", F.coalesce("__in", "__before")["__mark"].alias(mark))


def first_from(points: DataFrame, marks: DataFrame, on: list[str], *, at: str = "at", mark_at: str = "mark_at", mark: str = "mark", width: int = 100_000) -> DataFrame:
    """``points`` with ``mark``: the first one at the point or behind it; of several at one place the greatest."""
    back = lambda df, c: df.withColumn("__mirror", -F.col(c))
    found = last_before(back(points, at), back(marks, mark_at).drop(mark_at).withColumnRenamed("__mirror", mark_at), on, at="__mirror", mark_at=mark_at, mark=mark, strict=False, width=width)
    return found.drop("__mirror")
