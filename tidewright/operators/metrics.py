"""Evaluation: confusion, precision and recall, purity, calibration, AUC, Brier, concordance, censored labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.sources.scratch import checkpointed


def pair_prf(clusters: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One row: pairwise precision, recall and F1. Pairs are counted from group sizes, never formed."""
    pairs = lambda *keys: clusters.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("p"))
    both, found, real = (pairs(*k).select(F.col("p").alias(name)) for k, name in (((truth, cluster), "tp"), ((cluster,), "found"), ((truth,), "real")))
    j = both.crossJoin(found).crossJoin(real)  # three single rows
    p, r = F.try_divide("tp", "found"), F.try_divide("tp", "real")
    return j.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def purity(clusters: DataFrame, truth: str, cluster: str) -> DataFrame:
    sizes = clusters.groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n")).groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return sizes.agg(F.round(F.sum("top") / F.sum("n"), 6).alias("purity"), F.count_if(F.col("top") < F.col("n")).alias("impure"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, observed) over equal-width bins of the score: fixed edges, so ties can't fall apart."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("predicted"), F.round(F.avg(F.col(label).cast("double")), 6).alias("observed"))


def auc_brier(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: AUC by rank sums and the Brier score. Equal scores are counted first, so only distinct scores are ranked."""
    per = checkpointed(df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")))
    ranked = running(per, "s", ["neg"])
    area = ranked.agg(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    brier = df.agg(F.round(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier"))
    return area.select(F.round(F.try_divide("a", F.col("p") * F.col("q")), 6).alias("auc")).crossJoin(brier)


def censored_label(start: Column, end: Column, horizon_days: int, data_end: Column) -> Column:
    """1: still open after the horizon, 0: closed within it, -1: can't be known yet."""
    return F.when(end.isNotNull(), (F.date_diff(end, start) > horizon_days).cast("int")).when(F.date_diff(data_end, start) > horizon_days, 1).otherwise(-1)


def set_prf(found: DataFrame, truth: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall) of two sets of rows, by one of their columns; repeats count once."""
    side = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(1))
    j = side(found, "f").join(side(truth, "t"), keys, "full_outer")
    out = j.groupBy(by).agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return out.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6))


def threshold_sweep(scored: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall): all thresholds from one pass over the rows."""
    p, y = F.col(score), F.col(label) == 1
    one = scored.agg(F.count_if(y).alias("real"), *[x for k, t in enumerate(thresholds) for x in (F.count_if(p >= t).alias(f"n{k}"), F.count_if((p >= t) & y).alias(f"tp{k}"))])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.round(F.try_divide(f"tp{k}", f"n{k}"), 6).alias("precision"), F.round(F.try_divide(f"tp{k}", "real"), 6).alias("recall")) for k, t in enumerate(thresholds)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def decile_calibration(scored: DataFrame, p: str, y: str, groups: int = 10) -> DataFrame:
    """(bin, n, predicted, observed) between exact quantiles of the predictions; equal edges fall together, and a
    prediction on an edge belongs below it. Quantiles between two ranks are interpolated; the rows at those ranks are
    found by running counts, so no task holds all values."""
    per = checkpointed(scored.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = [k / groups * (total - 1) for k in range(1, groups)] if total else []
    ranks = sorted({int(f(x)) for x in places for f in (np.floor, np.ceil)})
    ranked = running(per, "v", ["n"])
    wanted = F.array(*map(F.lit, ranks or [-1]))
    hit = F.filter(wanted, lambda r: (r >= F.col("below_n")) & (r < F.col("below_n") + F.col("n")))
    at = {r: x["v"] for x in ranked.select("v", hit.alias("h")).where("size(h) > 0").collect() for r in x["h"]}  # two rows an edge at most
    edges = sorted({at[int(np.floor(x))] + (x - np.floor(x)) * (at[int(np.ceil(x))] - at[int(np.floor(x))]) for x in places})
    binned = scored.withColumn("bin", F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>"), lambda e: e < F.col(p))))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("predicted"), F.round(F.avg(y), 6).alias("observed"))


#: Distinct values of a block that one task ranks, and blocks at most.
ROWS, BLOCKS = 100_000, 2_000


def _edges(df: DataFrame, by: str, rows: int) -> np.ndarray:
    """Values that cut `df` into blocks of about `rows` rows: as many as there are blocks come to the driver."""
    n = min(BLOCKS, -(-df.count() // rows))
    return np.unique(df.approxQuantile(by, [k / n for k in range(1, n)], 0.1 / n)) if n > 1 else np.empty(0)


def running(df: DataFrame, by: str, sums: list[str], rows: int = ROWS) -> DataFrame:
    """`df` with below_<c> for each of `sums`: its sum over all rows of a smaller `by`, which no two rows share.

    Ranges of `by` are summed each by itself; the totals of the ranges before are added. No window is without a
    partition, and a range's size doesn't depend on how often a value occurs, as values are distinct."""
    edges = _edges(df, by, rows)

    @F.pandas_udf("int")
    def block(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(float), "left").astype(np.int32))

    dealt = df.withColumn("_block", block(F.col(by).cast("double")) if len(edges) else F.lit(0))
    totals = {r["_block"]: r for r in dealt.groupBy("_block").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
    before = {c: np.concatenate(([0], np.cumsum([totals[b][c] if b in totals else 0 for b in range(len(edges) + 1)]))).tolist() for c in sums}
    over = Window.partitionBy("_block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    below = {f"below_{c}": F.coalesce(F.sum(c).over(over), F.lit(0)) + F.get(F.array(*map(F.lit, before[c])), F.col("_block")) for c in sums}
    return dealt.withColumns(below).drop("_block")


def lower_later(risk: np.ndarray, own: np.ndarray, all_: np.ndarray) -> tuple[int, int]:
    """Over places i < j: the sum of own[i] * all_[j] where risk[j] < risk[i], and where they are equal.

    Pairs are split by the highest bit in which their places differ: at each bit, runs of places are sorted by risk and
    sums below a risk read off a running total."""
    n, lower, equal = len(risk), 0, 0
    _, rank = np.unique(risk, return_inverse=True)
    place = np.arange(n)
    for bit in range(max(n - 1, 0).bit_length()):
        key = (place >> (bit + 1)) * (n + 1) + rank
        order = np.argsort(key, kind="stable")
        k, late = key[order], (order >> bit) & 1
        total = np.concatenate(([0], np.cumsum(all_[order] * late)))
        head, tail, start = np.searchsorted(k, k, "left"), np.searchsorted(k, k, "right"), np.searchsorted(k, k // (n + 1) * (n + 1), "left")
        early = own[order] * (1 - late)
        lower += int((early * (total[head] - total[start])).sum())
        equal += int((early * (total[tail] - total[head])).sum())
    return lower, equal


def concordance_all(rows: DataFrame, time: str, ended: str, risk: str, block: int = ROWS) -> DataFrame:
    """One row (c_index, pairs) over all pairs of rows: of one that ended and one whose time is longer (or that was still
    open at the same time), the share in which the first has the higher risk, equal risks counting half.

    Times are whole numbers; rows without a time or risk are dropped. No pair is formed: rows are counted by time and
    risk, both are cut into ranges, and a value that many rows share is a range of its own. Pairs of different ranges
    follow from the counts of range pairs (bounded by the number of ranges, on the driver); pairs in one range of times
    or of risks are counted there by sorting, n log n rows of work in tasks of a bounded number of distinct values."""
    open_ = (~F.coalesce(F.col(ended), F.lit(False))).cast("long")
    points = rows.where(F.col(time).isNotNull() & F.col(risk).isNotNull()).select((F.col(time).cast("long") * 2 + open_).alias("u"), F.col(risk).cast("double").alias("r"))
    points = checkpointed(points.groupBy("u", "r").agg(F.count(F.lit(1)).alias("n")))
    edges_u, edges_r = _edges(points, "u", block), _edges(points, "r", block)

    def ranges(edges: np.ndarray):
        @F.pandas_udf("int")
        def of(x: pd.Series) -> pd.Series:
            v = x.to_numpy(float)
            at = np.searchsorted(edges, v, "left")
            alone = np.isin(v, edges)
            return pd.Series((2 * at + alone).astype(np.int32))  # an edge is a range of its own, odd

        return of

    p = points.withColumn("ub", ranges(edges_u)(F.col("u").cast("double"))).withColumn("rb", ranges(edges_r)(F.col("r")))
    p = checkpointed(p.withColumn("e", F.when(F.col("u") % 2 == 0, F.col("n")).otherwise(0)))
    cells = p.groupBy("ub", "rb").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).collect()
    shape = (2 * len(edges_u) + 2, 2 * len(edges_r) + 2)
    all_, own = np.zeros(shape, object), np.zeros(shape, object)
    for c in cells:
        all_[c["ub"], c["rb"]], own[c["ub"], c["rb"]] = c["n"], c["e"]
    later = np.zeros(shape, object)
    later[:-1] = np.cumsum(all_[::-1], axis=0)[::-1][1:]  # rows of later ranges of times, by range of risk
    below = np.concatenate([np.zeros((shape[0], 1), object), np.cumsum(later, axis=1)[:, :-1]], axis=1)
    pairs, lower = int((own * later.sum(axis=1)[:, None]).sum()), int((own * below).sum())
    equal = int((own * later)[:, 1::2].sum())  # a range of one risk: all of them are equal

    def in_times(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "r"])
        u, e, n = (pdf[c].to_numpy(np.int64) for c in ("u", "e", "n"))
        tail = np.concatenate((np.cumsum(n[::-1])[::-1], [0]))
        low, same = lower_later(pdf["r"].to_numpy(float), e, n)
        return pd.DataFrame({"pairs": [int((e * tail[np.searchsorted(u, u, "right")]).sum())], "lower": [low], "equal": [same]})

    def in_risks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby(["ub", "r"], as_index=False)[["e", "n"]].sum().sort_values(["ub", "r"])
        low, same = lower_later(pdf["r"].to_numpy(float), pdf["e"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"pairs": [0], "lower": [low], "equal": [same]})

    counts = "pairs long, lower long, equal long"
    inner = p.where("ub % 2 = 0").groupBy("ub").applyInPandas(in_times, counts).unionByName(p.where("rb % 2 = 0").groupBy("rb").applyInPandas(in_risks, counts))
    total = inner.agg(*[(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)") + F.lit(str(k)).cast("decimal(38,0)")).alias(c) for c, k in (("pairs", pairs), ("lower", lower), ("equal", equal))])
    share = (F.col("lower").cast("double") + F.col("equal").cast("double") / 2) / F.nullif(F.col("pairs").cast("double"), F.lit(0.0))
    return total.select(F.round(share, 6).alias("c_index"), F.col("pairs").cast("long").alias("pairs"))


def concordance(rows: DataFrame, strata: list[str], time: str, ended: str, risk: str) -> DataFrame:
    """(c_index, pairs): pairs of a stratum in which one ends before the other's time; the share in which it has the higher
    risk, ties counting half. Strata bound the pairs: a stratum of n rows gives n (n - 1) / 2 at most."""
    a = rows.where(F.col(ended)).select(*strata, F.col(time).alias("_t"), F.col(risk).alias("_r"))
    b = rows.select(*strata, F.col(time).alias("_u"), F.col(risk).alias("_s"))
    pairs = a.join(b, strata).where("_t < _u")
    one = F.when(F.col("_r") > F.col("_s"), 1.0).when(F.col("_r") == F.col("_s"), 0.5).otherwise(0.0)
    return pairs.agg(F.round(F.sum(one) / F.count(F.lit(1)), 6).alias("c_index"), F.count(F.lit(1)).alias("pairs"))
