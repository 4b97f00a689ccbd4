"""Items that stand together more often than chance: exact pair counts against a fitted bipartite configuration model.

In the model item i stands in record r with the probability x_i y_r / (1 + x_i y_r), independently, with x and y such that every item has its observed number of
records and every record its observed number of items on average. Items of equal count and records of equal size have equal parameters, so the fit needs only how many there are of
each: counts and sizes up to EXACT stand for themselves, greater ones in bins of one percent, so that two or three thousand bins hold any collection; a parameter
between two bins is interpolated. The count of a pair is then a sum of independent trials, a Poisson-binomial variable; its tail comes from the saddle point, and
the rate of false discoveries is held by the step-up rule over all pairs.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.plans.lineage import store

LONG = 1024  # items of a record beyond which its pairs are made in several tasks
EXACT = 256  # counts and sizes up to this have a bin of their own
STEP = 0.01  # growth of the bins beyond
ROUNDS = 20_000
TOLERANCE = 1e-8
ALWAYS, NEVER = 1e30, 1e-15  # parameters of what is in everything, and of what is only in or with those
STEPS = 100  # bins of log10 p per unit, from which the step-up rule starts


def binned(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean value and number of the values n in each bin, the mean rising; at most some 3000 bins reach the driver."""
    at = F.when(F.col("n") <= EXACT, F.col("n").cast("double")).otherwise(EXACT + F.floor(F.log(F.col("n") / F.lit(float(EXACT))) / F.lit(float(np.log1p(STEP)))) + 1.0)
    rows = df.groupBy(at.alias("bin")).agg(F.sum("n").alias("total"), F.count("*").alias("many")).orderBy("bin").collect()
    many = np.array([r["many"] for r in rows], np.float64)
    return np.array([r["total"] for r in rows], np.float64) / many, many


def fit(item_counts: np.ndarray, items: np.ndarray, sizes: np.ndarray, records: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """x for each item count and y for each record size, given how many items and records there are of each.

    What every record has, or a record that has everything, leaves nothing to chance: such are taken out first, in turn, and what then has nothing left as well. For the rest each round gives
    every item, then every record, its number under what the other side has now, until all item counts are met within TOLERANCE; a warning says how far they are off if that does not come.
    """
    x, y = np.full(len(items), np.nan), np.full(len(records), np.nan)
    k, d = item_counts.astype(np.float64), sizes.astype(np.float64)
    while True:
        i, r = np.isnan(x), np.isnan(y)
        n_items, n_records = items[i].sum(), records[r].sum()
        all_of, none_of = i & (k >= n_records), i & (k <= 0)
        if (all_of | none_of).any() and n_records:
            x[none_of], x[all_of & ~none_of] = NEVER, ALWAYS
            d = d - items[all_of & ~none_of].sum()
            continue
        all_of, none_of = r & (d >= n_items), r & (d <= 0)
        if not ((all_of | none_of).any() and n_items):
            break
        y[none_of], y[all_of & ~none_of] = NEVER, ALWAYS
        k = k - records[all_of & ~none_of].sum()
    i, r = np.isnan(x), np.isnan(y)
    x[np.isnan(x) & ~r.any()], y[np.isnan(y) & ~i.any()] = NEVER, NEVER
    if not (i.any() and r.any()):
        return x, y
    k, d, n, m = k[i], d[r], items[i], records[r]
    a, b = k / max(1.0, np.sqrt((k * n).sum())), d / max(1.0, np.sqrt((d * m).sum()))
    off = np.inf
    for _ in range(rounds):
        per = (m * b / (1 + a[:, None] * b[None, :])).sum(axis=1)
        off = np.abs(a * per / k - 1).max()
        if off < TOLERANCE:
            break
        a = k / per
        b = d / ((n * a)[:, None] / (1 + a[:, None] * b[None, :])).sum(axis=0)
    else:
        warnings.warn(f"after {rounds} rounds the model meets the item counts within {off:.1e} only", stacklevel=2)
    x[i], y[r] = a, b
    return x, y


def interpolated(n: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The parameter of items of count n: that of their bin where its count is n, else between the bins, linear in the logarithms."""
    return np.exp(np.interp(np.log(n), np.log(counts), np.log(x)))


_ERFC_FAR = 25.0


def _normal_tail(w: np.ndarray) -> np.ndarray:
    from math import erfc, sqrt

    return np.array([0.5 * erfc(v / sqrt(2)) if v < _ERFC_FAR else 0.0 for v in w])


def log_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log10 of P(X >= n) for X the sum over s of Binomial(m[s], q[:, s]), row by row: saddle point with the correction for whole numbers."""
    n = n.astype(np.float64)
    q = np.clip(q, 1e-300, 1 - 1e-12)
    low, high = np.full(len(n), -60.0), np.full(len(n), 700.0)
    target = np.clip(n, 1e-9, m.sum() - 0.5)
    s = np.clip(np.log(target / np.maximum(q @ m, 1e-300)), -59.0, 699.0)
    left = np.arange(len(n))
    for _ in range(200):  # K'(s) rises with s: Newton steps, halving where one would leave the bracket
        qs = q[left]
        with np.errstate(over="ignore"):
            t = qs / (qs + (1 - qs) * np.exp(-s[left])[:, None])
        value, slope = t @ m - target[left], (t * (1 - t)) @ m
        low[left] = np.where(value < 0, s[left], low[left])
        high[left] = np.where(value >= 0, s[left], high[left])
        with np.errstate(divide="ignore", invalid="ignore"):
            new = s[left] - value / slope
        new = np.where((new > low[left]) & (new < high[left]), new, (low[left] + high[left]) / 2)
        moving = np.abs(new - s[left]) > 1e-12 * (1 + np.abs(new))
        s[left] = new
        left = left[moving]
        if not len(left):
            break
    t = q / (q + (1 - q) * np.exp(-s)[:, None])
    k = ((np.where(s[:, None] > 30, s[:, None] + np.log(q), np.log1p(q * np.expm1(np.minimum(s, 30))[:, None]))) * m).sum(axis=1)
    k2 = (t * (1 - t)) @ m
    gain = np.maximum(s * target - k, 0)
    w = np.sign(s) * np.sqrt(2 * gain)
    u = -np.expm1(-s) * np.sqrt(np.maximum(k2, 1e-300))
    near = np.abs(w) < 1e-3
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(near, 0.5, _normal_tail(w) + np.exp(-gain) / np.sqrt(2 * np.pi) * (1 / u - 1 / w))
        far = (-gain - 0.5 * log(2 * pi) + np.log(np.maximum(1 / u - 1 / w + 1 / np.maximum(w, 1) * (1 - 1 / np.maximum(w, 1) ** 2), 1e-300))) / np.log(10)
        out = np.where(w > 20, far, np.log10(np.clip(p, 1e-300, 1.0)))
    return np.where(n <= 0, 0.0, np.where(n > m.sum(), -np.inf, np.minimum(out, 0.0)))


def rejection_limit(scored: DataFrame, tests: int, rate: float) -> float:
    """The greatest log10 p that the step-up rule rejects: p <= rate * rank / tests. A histogram of log10 p gives a limit from above; a few counts over all pairs then make it exact."""
    if not tests:
        return -np.inf
    rows = scored.groupBy(F.ceil(F.greatest("log10_p", F.lit(-1e6)) * STEPS).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()  # bounded by the range of log10 p
    limit = np.log10(rate)
    upper, rank = np.array([r["bin"] for r in rows], np.float64), np.cumsum([r["n"] for r in rows])

    def step(rejected: int) -> float:
        return np.log10(rate * rejected / tests) if rejected else -np.inf

    while True:  # a bin counts as rejected if its lower end is
        below = np.flatnonzero((upper - 1) / STEPS <= limit)
        new = min(limit, step(int(rank[below[-1]]) if len(below) else 0))
        if new >= limit or new == -np.inf:
            limit = new
            break
        limit = new
    while limit > -np.inf:
        new = min(limit, step(scored.filter(F.col("log10_p") <= float(limit)).count()))
        if new >= limit:
            break
        limit = new
    return limit


def pair_counts(baskets: DataFrame, min_count: int, long: int = LONG, longest: float = float("inf"), counts: DataFrame | None = None) -> DataFrame:
    """(a, b, n_ab), a < b, of items in at least min_count common records; baskets is (record, item), each once.

    Items of fewer than min_count records are dropped first, as no pair with them can count. Where fewer than min_count records are longer than long, they are
    only looked up for the pairs that shorter records make possible; otherwise their items are split into chunks that meet in separate tasks. longest is the size of
    the longest record and counts the number of records of each item (item, n), if known. An item of many records is a skewed key of the joins on items, which adaptive execution splits.
    """
    counts = baskets.groupBy("item").agg(F.count("*").alias("n")) if counts is None else counts
    often = counts.filter(F.col("n") >= min_count).select("item")
    kept = baskets.join(often, "item") if min_count > 1 else baskets
    sizes = kept.groupBy("record").agg(F.count("*").alias("size"))
    lengthy = sizes.filter(F.col("size") > long)
    n_long = lengthy.count() if longest > long else 0

    def pairs(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        both = x.withColumnRenamed("item", "a").join(y.withColumnRenamed("item", "b"), on).filter("a < b")
        return both.groupBy("a", "b").agg(F.count("*").alias("n_ab"))

    if not n_long:
        return pairs(kept, kept, ["record"]).filter(F.col("n_ab") >= min_count)
    short = kept.join(lengthy, "record", "left_anti")
    few = pairs(short, short, ["record"])
    rows = kept.join(lengthy, "record")
    if n_long < min_count:
        possible = few.filter(F.col("n_ab") >= min_count - n_long)
        held = possible.join(rows.select(F.col("item").alias("a"), "record"), "a").join(rows.select(F.col("item").alias("b"), "record"), ["b", "record"])
        extra = held.groupBy("a", "b").agg(F.count("*").alias("n_ab"))
        every = possible.unionByName(extra)
    else:
        n_chunks = F.ceil(F.col("size") / long).cast("int")
        right = rows.withColumn("chunk", F.pmod(F.xxhash64("item"), n_chunks).cast("int")).drop("size")
        left = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1))).drop("size")
        every = few.unionByName(pairs(left, right, ["record", "chunk"]))
    return every.groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab")).filter(F.col("n_ab") >= min_count)


def together(rows: DataFrame, record_column: str, item: F.Column, min_count: int = 1, false_discoveries: float = 0.05, long: int = LONG, significance: bool = True) -> DataFrame:
    """Pairs of items in at least min_count common records, and how far that exceeds chance.

    Columns: item_a < item_b, n_a, n_b, n_ab, n_records (records with an item), lift = n_ab * n_records / (n_a * n_b), expected and log10_p under the model,
    significant (unless it is not asked for): by the step-up rule at that rate, over all pairs of items whether they meet or not. Null records, null and empty items are ignored;
    an item counts once in a record; an empty table gives no row. Nothing is sampled or cut: every pair of min_count is counted exactly.
    """
    baskets = rows.select(F.col(record_column).alias("record"), item.alias("item")).filter("record IS NOT NULL AND item <> ''").distinct()
    baskets = store(baskets, "baskets")
    counts = store(baskets.groupBy("item").agg(F.count("*").alias("n")), "counts")
    degree, items = binned(counts)
    sizes, records = binned(baskets.groupBy("record").agg(F.count("*").alias("n")))
    n_items, n_records = int(items.sum()), int(records.sum())
    x, y = fit(degree, items, sizes, records)
    model = rows.sparkSession.sparkContext.broadcast((degree, x, y, records))  # bounded by the number of bins

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degree, x, y, m = model.value
        step = max(1, (1 << 20) // max(1, len(m)))
        for batch in batches:
            # Pairs of equal counts are equally surprising, and rare items have few different ones.
            known, which = np.unique(np.stack([batch.column(c).to_numpy() for c in ("n_a", "n_b", "n_ab")], axis=1), axis=0, return_inverse=True)
            expected, log10_p = np.zeros(len(known)), np.zeros(len(known))
            for low in range(0, len(known), step):
                part = known[low : low + step]
                q = 1.0
                for c in (0, 1):
                    odds = interpolated(part[:, c], degree, x)[:, None] * y[None, :]
                    q = q * (odds / (1 + odds))
                expected[low : low + step], log10_p[low : low + step] = q @ m, log_tail(part[:, 2], q, m)
            which = which.reshape(-1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected[which]), pa.array(log10_p[which])], [*batch.schema.names, "expected", "log10_p"])

    counted = pair_counts(baskets, min_count, long, float(sizes.max()) if len(sizes) else 0.0, counts)
    counted = counted.join(counts.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    counted = counted.select("a", "b", "n_a", "n_b", "n_ab")
    scored = store(counted.mapInArrow(score, "a string, b string, n_a long, n_b long, n_ab long, expected double, log10_p double"), "pairs")
    limit = rejection_limit(scored, n_items * (n_items - 1) // 2, false_discoveries) if significance else None
    lift = F.col("n_ab") * F.lit(float(n_records)) / (F.col("n_a") * F.col("n_b"))
    out = [F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_a", "n_b", "n_ab", F.lit(n_records).cast("long").alias("n_records"), lift.alias("lift"), "expected", "log10_p"]
    return scored.select(*out, *([(F.col("log10_p") <= float(limit)).alias("significant")] if significance else []))
