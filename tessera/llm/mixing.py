"""Mixing sources to target weights by pivotal dependent rounding of copy counts.

1. ``sizes``: one pass over the texts leaves (identifier, source, words); equal rows become one with their number.
2. ``targets``: sources take the weights in turn, in code-point order, and share all words; a source stops at
   ``most_copies`` times its size and the excess is shared again by weight until none is above.  This runs on the
   table of sources, in whole numbers, so it is exact; only three sums a round reach the driver.
3. Every document gets the whole copies of its source's rate (target / size).  What is left is a fraction of one more
   copy, or, in words, a mass between 0 and the document's size.
4. ``round_masses``: two documents of a source transfer mass until one of them holds none or all of its size.  Which
   way is random, with odds that keep every document's expected mass; a source's sum of masses never changes.  This
   runs inside buckets of a bounded size; the one document of each that stays undecided goes on to the next level of
   a reduction tree, where ``fan_in`` buckets meet, until one document of a source is left.  It has no partner and goes
   to the nearer side, so a source misses its target by half of one document at most, mostly a small one.

Nothing depends on how rows are dealt to tasks: buckets, orders and random numbers are hashes of the rows themselves,
so reruns agree.

Defined cases: a null source is the last one; a null or blank text has size 0 and is taken with 0 words; rows without
an identifier and equal rows take part row by row (of k equal rows, those that get one more copy are any of them); a
source whose documents have no words has the target 0; very long texts are one document; an empty table gives an empty
result; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
UNIT = "doc_id long, size long, rows long, source_size long, target double, base long, whole long, mass double, h long, source_no long, bucket long"
COLUMNS = [c.split()[0] for c in UNIT.split(", ")]


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, source, size, rows): equal ones are added up, within the map tasks first."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))


def numbered(sources: DataFrame, scratch: Scratch, ranges: int = 200) -> DataFrame:
    """Sources with their place in code-point order, null last: each range starts where the rows of those before it end."""
    nulls = F.col("source").isNull()
    placed = scratch.put(sources.repartitionByRange(ranges, nulls, "source").withColumn("range", F.spark_partition_id()), "ranges")
    counts = dict(placed.groupBy("range").count().collect())  # at most ``ranges`` rows
    starts, at = [F.lit(None).cast("int"), F.lit(0)], 0
    for r in sorted(counts):
        starts += [F.lit(r), F.lit(at)]
        at += counts[r]
    within = F.row_number().over(Window.partitionBy("range").orderBy(nulls, "source")) - 1
    return placed.withColumn("source_no", F.element_at(F.create_map(*starts[2:]), F.col("range")) + within if counts else F.lit(0)).drop("range")


def targets(units: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = WEIGHTS, most_copies: int = 3) -> tuple[DataFrame, int]:
    """The sources with their size, number of units, place and target, and their number."""
    sources = scratch.put(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units")), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = scratch.put(numbered(sources, scratch).withColumn("weight", weight), "ranked")
    n, total = ranked.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    cap = most_copies * F.col("source_size")
    capped, level = F.lit(False), (0, 1)  # a weight's share of words as a fraction of whole numbers
    while total:
        held, open_weight = ranked.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if not open_weight or level == (total - held, open_weight):
            break
        level = (total - held, open_weight)
        capped = F.col("weight").cast("decimal(9,0)") * F.lit(level[0]).cast("decimal(19,0)") > cap.cast("decimal(19,0)") * F.lit(level[1]).cast("decimal(18,0)")
    target = F.when(capped, cap.cast("double")).otherwise(F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1])))
    return ranked.withColumn("target", target), n


def with_targets(units: DataFrame, sources: DataFrame, n: int, broadcast_sources: int = 100_000, salts: int = 32) -> DataFrame:
    """Every unit with its source's columns; many sources are joined by shuffle, each dealt over ``salts`` keys."""
    if n <= broadcast_sources:
        return units.join(F.broadcast(sources.withColumnRenamed("source", "named")), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    left = units.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)))
    right = sources.withColumnRenamed("source", "named").withColumn("salt_no", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, F.col("source").eqNullSafe(F.col("named")) & (F.col("salt") == F.col("salt_no"))).drop("named", "salt", "salt_no")


def round_masses(group: np.ndarray, size: np.ndarray, mass: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Masses after the transfers: of each group, whose rows are together, one at most is neither 0 nor its size.

    The undecided row meets the group's next one, and the pair transfers mass until one of the two is decided; ``draw``
    is a random number of the newcomer.  With sizes in falling order large rows are decided among each other and then
    by many small ones, so the last undecided row is mostly a small one.
    """
    out, held = mass.tolist(), -1
    groups, sizes, draws = group.tolist(), size.tolist(), draw.tolist()
    for j in np.flatnonzero((mass > 0) & (mass < size)).tolist():
        i, held = held, j
        if i < 0 or groups[i] != groups[j]:
            continue
        up_i, up_j = min(sizes[i] - out[i], out[j]), min(out[i], sizes[j] - out[j])
        # the smaller a direction's step, the likelier it is taken, so every expected mass stays
        a, b = (i, j) if draws[j] * (up_i + up_j) < up_j else (j, i)  # from b to a
        if sizes[a] - out[a] <= out[b]:
            out[a], out[b] = sizes[a], out[b] - (sizes[a] - out[a])
        else:
            out[a], out[b] = out[a] + out[b], 0.0
        open_ = [k for k in (a, b) if 0 < out[k] < sizes[k]]
        held = open_[0] if open_ else -1
    return np.array(out, dtype=np.float64)


def _level(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source_no", "bucket", "size", "h", "doc_id"], ascending=[True, True, False, True, True], ignore_index=True)
        group = pdf.groupby(["source_no", "bucket"], sort=False).ngroup().to_numpy()
        size, bits = pdf["size"].to_numpy().astype(np.float64), mix64(pdf["h"].to_numpy().view(np.uint64) + np.uint64(level))
        mass = round_masses(group, size, pdf["mass"].to_numpy(), (bits >> np.uint64(11)) * 2.0**-53)
        if last:  # one document of a source at most, which has no partner
            mass = np.where((mass > 0) & (mass < size), np.where(2 * mass > size, size, 0.0), mass)
        return pdf.assign(mass=mass)[COLUMNS]

    return run


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_copies: int = 3, bucket_units: int = 1000, fan_in: int = 256, seed: int = 0, **columns: str) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    units = scratch.put(sizes(docs, **columns), "units")
    sources, n = targets(units, scratch, weights=weights, most_copies=most_copies)
    most, total = sources.agg(F.coalesce(F.max("units"), F.lit(0)), F.coalesce(F.sum("units"), F.lit(0))).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = F.ceil(F.col("units") / bucket_units)
    begun = (
        with_targets(units, sources, n)
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "source_no"))
        .withColumn("base", F.least(F.floor(rate), F.lit(most_copies)))
        .withColumn("part", F.col("rows") * F.greatest(rate - F.col("base"), F.lit(0.0)))
        .withColumn("whole", F.least(F.floor("part"), F.col("rows") - 1))
        .withColumn("mass", F.least((F.col("part") - F.col("whole")) * F.col("size"), F.col("size").cast("double")))
        .withColumn("bucket", F.pmod(F.xxhash64("h"), buckets))
        .select(*(F.col(c).cast(kind) for c, kind in (x.split() for x in UNIT.split(", "))))
    )
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    done, todo = [begun.where(~open_)], begun.where(open_)
    widest, count, level = max(1, -(-most // bucket_units)), total, 0
    while True:
        shards = max(1, -(-count // bucket_units))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("source_no", "bucket"), F.lit(shards)))
        rounded = scratch.put(dealt.groupBy("shard").applyInPandas(_level(level, widest == 1), UNIT), f"level{level}")
        done.append(rounded.where(~open_))
        if widest == 1:
            break
        count = -(-total // bucket_units) + n if level == 0 else -(-count // fan_in) + n  # one open unit a bucket at most
        todo = rounded.where(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        widest, level = -(-widest // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    extra = F.col("whole") + F.when(F.col("mass") > 0, 1).otherwise(0)
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    taken = F.col("size") * (F.col("base") + F.when(F.col("row") <= F.col("extra"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", "base", extra.alias("extra"), row.alias("row")).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
