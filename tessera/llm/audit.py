"""Filter interaction audit: what each filter of a chain removes, in every order, by a subset-zeta transform.

1. Every document becomes a mask of the filters that it fails.  What the text alone decides is one projection; the
   text itself stays there, and a digest of it travels on.  Whether a smaller identifier has the same text is decided
   on counts: rows of one digest are added up first (within the map tasks already), and of each digest only those of
   the smallest identifier pass.
2. Masks are counted per part, in all and among good and toxic documents: at most 32 rows a part and label.
3. For each part the zeta transform over subsets turns these counts into the survivors of every subset of filters.
   A step of any order is then the difference of two neighbouring subsets, and a filter's Shapley sum weighs each
   such difference by the number of orders that show it.

Defined cases: null text is the empty text, which fails A only (and E, if a smaller identifier's text is empty too);
null language is the part ``''``; rows without an identifier fail E never and have no labels; equal rows are counted
as often as they occur and pass E together; a document with several rows in ``labels`` is good or toxic if any says so;
an empty table has no part and no row; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, good, toxic, mask, n): how many documents of a part and label fail exactly the filters of ``mask``."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    # word lists are a column of their own, so that a list is made once and not in each expression that reads it
    listed = read.select("id", "part", "body", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)).alias("words"))
    words, distinct, points = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long"), F.length("body").cast("long")
    capitals = points - F.length(F.regexp_replace("body", "[A-Z]+", ""))
    fails = (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, F.col("body").rlike(r"[#$%&*|]"))
    mask = sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))
    judged = listed.select("id", "part", F.sha2(F.col("body").cast("binary"), 256).alias("digest"), mask.alias("mask"))

    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("one", F.lit(0))
    counted = judged.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest", "part")).otherwise(0)  # rows without an identifier meet nobody: let them spread
    known = counted.join(marks, (counted["id"] == marks["label_id"]) & (spread == marks["one"]), "left").select("id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    per_text = known.groupBy("digest", "part", "good", "toxic", "mask").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    smallest = F.min("first.id").over(Window.partitionBy("digest"))  # a digest has a row for each part and label at most
    passing = F.col("unnamed") + F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(0)
    either = per_text.select("part", "good", "toxic", "mask", "n", passing.alias("passing")).select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))))
    return either.where("n > 0").groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))


def zeta(counts: np.ndarray) -> np.ndarray:
    """Sums over subsets: entry ``u`` becomes the sum of the entries whose bits all lie in ``u``."""
    out = counts.copy()
    for bit in range(out.size.bit_length() - 1):
        pair = out.reshape(-1, 2, 1 << bit)
        pair[:, 1] += pair[:, 0]
    return out


def survivors(counts: np.ndarray) -> np.ndarray:
    """Entry ``s``: how many fail no filter of ``s``, that is, fail only filters of its complement."""
    return zeta(counts)[::-1]


def steps(part: str, rows: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from its mask counts."""
    n, size = len(FILTERS), 1 << len(FILTERS)

    def left(of: pd.DataFrame) -> np.ndarray:
        counts = np.zeros(size, dtype=np.int64)
        np.add.at(counts, of["mask"].to_numpy(), of["n"].to_numpy())
        return survivors(counts)

    kept, good, toxic = left(rows), left(rows[rows["good"] == 1]), left(rows[rows["toxic"] == 1])
    subsets = np.arange(size)
    fails, alone, shapley = [], [], []
    for f in range(n):
        without = subsets[subsets >> f & 1 == 0]
        weight = np.array([factorial(int(s).bit_count()) * factorial(n - 1 - int(s).bit_count()) for s in without], dtype=np.int64)
        drop = kept[without] - kept[without | 1 << f]
        fails.append(int(drop[0]))
        alone.append(int(drop[-1]))
        shapley.append(int((weight * drop).sum()))
    out = []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            f = FILTERS.index(letter)
            after = before | 1 << f
            removed = int(kept[before] - kept[after])
            out.append((part, order, k + 1, int(kept[after]), removed, fails[f] - removed, alone[f], int(good[before] - good[after]), int(toxic[before] - toxic[after]), shapley[f]))
            before = after
    return pd.DataFrame(out, columns=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the five filters and step; see the module's text."""
    return masks(docs, labels, **columns).groupBy("part").applyInPandas(lambda key, rows: steps(key[0], rows), SCHEMA)


ORACLE_SQL = """
    WITH RECURSIVE
    t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    d AS (
        SELECT t.doc_id, t.part,
            (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
            + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) THEN 4 ELSE 0 END)
            + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
            + (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask,
            coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
        FROM t LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = t.doc_id
    ),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    o(filter_order, used) AS (SELECT '', 0 UNION ALL SELECT filter_order || f, used + bit FROM o JOIN f ON used & bit = 0),
    s AS (SELECT filter_order, step, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE contains(left(filter_order, step - 1), g.f)) AS earlier FROM o, unnest(range(1, 6)) AS r(step) JOIN f ON f.f = substr(filter_order, step, 1) WHERE length(filter_order) = 5),
    e AS (
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
            sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM e
"""
