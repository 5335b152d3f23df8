"""Registers and queues: visible lists, wide summaries, redaction, freshness, versions of a person's data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective(value: Column, corrected: Column, status: Column) -> Column:
    """What a reviewer corrected, if they did, else the value as it was read."""
    return F.when((status == "corrected") & corrected.isNotNull(), corrected).otherwise(value)


def visible(df: DataFrame, *ways: Column) -> DataFrame:
    """Rows that any of the conditions lets through; an unknown condition lets nothing through."""
    open_ = F.lit(False)
    for way in ways:
        open_ = open_ | F.coalesce(way, F.lit(False))
    return df.where(open_)


def redacted(df: DataFrame, keep: list[str], hide: list[str], mark: str = "[hidden]") -> DataFrame:
    """Only the columns of `keep` and `hide`; what is hidden shows whether there is a value, not which."""
    return df.select(*keep, *[F.when(F.col(c).isNotNull(), mark).alias(c) for c in hide])


def json_or(text: Column, key: str, default: str) -> Column:
    """A key of a JSON object as text, or the default if it is missing, null or no JSON."""
    return F.coalesce(F.get_json_object(text, f"$.{key}"), F.lit(default))


def summary(parents: DataFrame, children: DataFrame, keys: list[str], order: list[str], days: str, needs: str, name: str = "cases") -> DataFrame:
    """`parents` with their children as one ordered array, how many there are, their most days and all their needs."""
    rest = [c for c in children.columns if c not in keys]
    packed = children.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias(name))
    out = parents.join(packed, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
    return out.withColumns({
        f"n_{name}": F.size(name), f"most_{days}": F.coalesce(F.array_max(F.transform(name, lambda x: x[days])), F.lit(0)), f"all_{needs}": F.aggregate(name, F.lit(0).cast("long"), lambda t, x: t + F.coalesce(x[needs], F.lit(0))),
    })


def fresh(results: DataFrame, as_of: Column, versions: dict[str, str]) -> DataFrame:
    """`results` with `stale`: computed for another day or by another version of the rules or the law."""
    same = F.col("as_of") == as_of
    for column, version in versions.items():
        same = same & (F.col(column) == version)
    return results.withColumn("stale", ~F.coalesce(same, F.lit(False)))


def variants(canonical: Column, *known: Column) -> Column:
    """All spellings of a name but the one that stands for it, sorted and distinct."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.array_distinct(F.concat(*[F.coalesce(k, none) for k in known])), F.array(canonical)))


def merged_map(left: Column, right: Column) -> Column:
    """Both maps in one; where both have a key, the right one's value counts."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON with its keys in order, nulls included: equal rows give equal text."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fused_confidence(values: DataFrame, keys: list[str], value: str, confidence: str) -> DataFrame:
    """(keys, value, confidence, n_sources, disputed): the value with most support 1 - prod(1 - confidence); `disputed` if
    other values were read too. Of equal support the smaller value stands."""
    one = values.groupBy(*keys, value).agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col(confidence), F.lit(1e-9)))))).alias("_c"), F.count(F.lit(1)).alias("_n"))
    top = F.min_by(F.struct(value, "_c", "_n"), F.struct((-F.round("_c", 9)).alias("a"), F.col(value).alias("b")))
    return one.groupBy(*keys).agg(top.alias("_t"), (F.count(F.lit(1)) > 1).alias("disputed")).select(*keys, F.col(f"_t.{value}").alias(value), F.round("_t._c", 6).alias("confidence"), F.col("_t._n").alias("n_sources"), "disputed")


def merged_variants(keep: Column, keep_known: Column, other: Column, other_known: Column) -> Column:
    """Spellings of a person after another was merged into it, sorted and distinct: those of both, and the other's own
    name unless it is the one that stays. The name that stays isn't taken out of what was known before."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(keep_known, none), F.coalesce(other_known, none), F.array_except(F.array(other), F.array(keep)))))


# What agreement adds, the most that it gives, and the most for a lone second reading and for a dispute.
AGREED, AT_MOST, ALONE, DISPUTED = 0.05, 0.99, 0.75, 0.5


def fused(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, confidence, method, disputed_by) of two readers' facts (keys, value, confidence), one a key each.

    The first reader governs. Where both read the same (but for case and blanks at the ends) the surer of them gains 0.05,
    0.99 at most; where they differ the first value stays at 0.5 at most and the other is named; what only the second
    read is to be confirmed, at 0.75 at most. A full outer join of the two."""
    side = lambda df, p: df.select(*keys, F.col("value").alias(f"{p}v"), F.col("confidence").alias(f"{p}c"), F.lit(True).alias(f"{p}"))
    j = side(first, "_a").join(side(second, "_b"), keys, "full_outer")
    same = F.lower(F.trim("_av")).eqNullSafe(F.lower(F.trim("_bv")))
    sure = F.when(F.col("_b").isNull(), F.col("_ac")).when(F.col("_a").isNull(), F.least("_bc", F.lit(ALONE))).when(same, F.least(F.lit(AT_MOST), F.greatest("_ac", "_bc") + AGREED)).otherwise(F.least("_ac", F.lit(DISPUTED)))
    method = F.when(F.col("_b").isNull(), "first").when(F.col("_a").isNull(), "second").when(same, "both").otherwise("disputed")
    value = F.when(F.col("_a").isNull(), F.col("_bv")).otherwise(F.col("_av"))
    return j.select(*keys, value.alias("value"), F.round(sure, 2).alias("confidence"), method.alias("method"), F.when(method == "disputed", F.col("_bv")).alias("disputed_by"))
