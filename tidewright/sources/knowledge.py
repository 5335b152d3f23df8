"""Knowledge files (YAML, or JSON, which is YAML too) of sections, mappings, rules and ingredients as tables with a version."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.law import overlaid

_TERM = "struct<years: int, months: int>"
_RECORD = (
    "act string, section string, title string, kind string, max_imprisonment string, aggravated_max_imprisonment string, min_imprisonment string, fine_only boolean, cognizable boolean, bailable boolean, compoundable boolean, triable_by string, "
    "special_law boolean, special_bail_restrictions string, default_bail_period_days int, source string, source_url string, notes string, verified boolean"
)
_MAPPING = "ipc string, bns array<string>, relation string, notes string, verified boolean"
_INGREDIENT = "sections array<string>, ingredient string, any_of array<string>, lesser map<string,string>, verified boolean"


class Knowledge(NamedTuple):
    records: DataFrame  #: act, section, key, kind, max_kind, max_months, ..., verified, verified_by: what `law.governed` needs
    mappings: DataFrame  #: old, new, relation, verified: a row for each pair
    rules: DataFrame  #: name, ref, verified, data (JSON)
    ingredients: DataFrame  #: section_key, ingredient, any_of, lesser, verified
    version: str


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record, mapping, rule and ingredient of a file as JSON, with its kind and place; file-wide values fill gaps."""
    try:
        from yaml import safe_load
    except ImportError:
        safe_load = json.loads
    for batch in batches:
        for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            doc = safe_load(text) or {}
            wide = {k: doc.get(k) for k in ("act", "source", "source_url") if doc.get(k)}
            rows = [("record", {**wide, **r}) for r in doc.get("records") or []]
            rows += [("mapping", m) for m in doc.get("mappings") or []]
            rows += [("rule", {"name": k, "data": v}) for k, v in (doc.get("rules") or {}).items()]
            rows += [("ingredient", g) for g in doc.get("ingredients") or []]
            said = [json.dumps({k: json.dumps(v) if k.endswith("imprisonment") and v is not None else v for k, v in r.items()}, default=str) for _, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([k for k, _ in rows], pa.string()), pa.array(said, pa.string())], names=["file", "place", "kind", "said"])


def _term(column: str, kind: str, months: str) -> list:
    """Columns of a term: "life", "death" or years and months; no term gives nulls."""
    raw = F.trim(F.col(column), F.lit('"'))
    span = F.from_json(F.col(column), _TERM)
    length = F.coalesce(span["years"], F.lit(0)) * 12 + F.coalesce(span["months"], F.lit(0))
    return [F.when(raw.isin("life", "death"), raw).when(F.col(column).isNotNull(), "term").alias(kind), F.when(F.col(column).isNotNull() & ~raw.isin("life", "death"), length).alias(months)]


def _digest(rows: DataFrame) -> str:
    """Twelve digits over all rows (x), in any order: hashes of 4,096 buckets of sorted hashes are all that is gathered."""
    hashed = rows.select(F.sha2("x", 256).alias("h"))
    of = lambda df, *key: df.groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return of(of(hashed, F.substring("h", 1, 3).alias("bucket")).select("h")).first()["h"][:12]


def knowledge(spark: SparkSession, path: str, overlay: DataFrame | None = None) -> Knowledge:
    """All knowledge files at `path` (a pattern), read by Spark whatever store they are in.

    Of a section that several files or places name, the last by path and place counts. `overlay` (key, verified,
    verified_by), with keys like "IPC:379" or "rule:section_479", tells what a reviewer has checked. Acts are written
    in capitals without dots. The version changes with the name or text of any file and with the overlay: the first
    twelve digits of a hash over them, put together from one row a file.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    seen = files.select(F.to_json(F.struct(F.substring_index("file", "/", -1).alias("file"), F.sha2("text", 256).alias("h"))).alias("x"))
    version = _digest(seen.unionByName(overlay.select(F.to_json(F.struct("key", "verified", "verified_by")).alias("x"))) if overlay else seen)
    parts = files.mapInArrow(_parts, "file string, place int, kind string, said string")
    of = lambda kind, schema: parts.where(F.col("kind") == kind).select("file", "place", F.from_json("said", schema).alias("r")).select("file", "place", "r.*")

    r = of("record", _RECORD).withColumn("act", F.upper(F.regexp_replace("act", r"[.\s]", "")))
    rest = [c for c in r.columns if c not in ("act", "section", "file", "place")]
    r = r.groupBy("act", "section").agg(F.max_by(F.struct(*rest), F.struct("file", "place")).alias("x")).select("act", "section", "x.*")
    r = r.select(
        "act", "section", F.concat_ws(":", "act", "section").alias("key"), "title", F.coalesce("kind", F.lit("offence")).alias("kind"),
        F.when(F.coalesce("fine_only", F.lit(False)) & F.col("max_imprisonment").isNull(), "none").otherwise(_term("max_imprisonment", "x", "y")[0]).alias("max_kind"), _term("max_imprisonment", "x", "max_months")[1],
        *_term("aggravated_max_imprisonment", "aggravated_kind", "aggravated_months"), _term("min_imprisonment", "x", "min_months")[1], F.coalesce("special_law", F.lit(False)).alias("special_law"), F.col("default_bail_period_days").alias("period_days"),
        "cognizable", "bailable", "compoundable", "triable_by", "special_bail_restrictions", "source", "source_url", F.coalesce("verified", F.lit(False)).alias("verified"),
    )
    m = of("mapping", _MAPPING).select(F.col("ipc").alias("old"), F.explode_outer("bns").alias("new"), "relation", F.coalesce("verified", F.lit(False)).alias("verified"))
    rule = of("rule", "name string, data string").groupBy("name").agg(F.max_by("data", F.struct("file", "place")).alias("data"))
    rule = rule.select(F.concat(F.lit("rule:"), "name").alias("key"), "name", F.get_json_object("data", "$.ref").alias("ref"), F.coalesce(F.get_json_object("data", "$.verified").cast("boolean"), F.lit(False)).alias("verified"), "data")
    if overlay:
        r, rule = overlaid(r, overlay, "key"), overlaid(rule, overlay, "key")
    g = of("ingredient", _INGREDIENT).select(F.explode("sections").alias("section_key"), "ingredient", "any_of", "lesser", F.coalesce("verified", F.lit(False)).alias("verified"))
    return Knowledge(r, m, rule, g, version)
