"""Anchors: neighbours of a query that are already mapped to the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.functions.names import has_prefix, truthy
from linkweave.policy import Policy


def _last(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pos")))).where("__k = 1").select(key, "reference_function_name")


def anchor_names(mappings: DataFrame) -> DataFrame:
    """query_id to reference name; the last accepted mapping of an id wins."""
    kept = mappings.where((F.col("status") == "accepted") & truthy("query_function_id") & truthy("reference_function_name"))
    return _last(kept.withColumn("query_id", F.col("query_function_id")), "query_id")


def seed_anchors(mappings: DataFrame) -> DataFrame:
    """query_key (the query's name, or else its id) to reference name; the last one wins."""
    key = F.when(truthy("query_function_name"), F.col("query_function_name")).otherwise(F.col("query_function_id"))
    return _last(mappings.where(F.col("status") == "accepted").withColumn("query_key", key).where(truthy("query_key") & truthy("reference_function_name")), "query_key")


def _first_by(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("case_id", "relation", name).orderBy("pos"))).where("__k = 1").drop("__k")


def _eligible(neighbours: DataFrame, cases: DataFrame, policy: Policy) -> DataFrame:
    """Named neighbours that are not the query itself."""
    joined = neighbours.join(cases.select("case_id", "query_func"), "case_id")
    return joined.where(truthy("name") & ~F.col("name").eqNullSafe(F.col("query_func"))).drop("query_func")


def visible_neighbours(neighbours: DataFrame, cases: DataFrame, names: DataFrame, policy: Policy) -> DataFrame:
    """Neighbours whose name is one of the reference's; first place of each name."""
    kept = _eligible(neighbours, cases, policy).where(~has_prefix("name", policy.exclude_prefixes)).join(names, "name", "left_semi")
    found = kept.groupBy("case_id", "relation", "name").agg(F.min("pos").alias("pos"))
    return found.select("case_id", "relation", "pos", F.col("name").alias("query_name"), F.col("name").alias("anchor"), F.lit("visible_reference_name").alias("source"))


def anchored_neighbours(neighbours: DataFrame, cases: DataFrame, seeds: DataFrame, names: DataFrame, policy: Policy) -> DataFrame:
    """A neighbour's seed mapping, which is taken as it is; else, if allowed, its own name where that is a visible
    reference name. First place of each reference name in each relation."""
    rows = _eligible(neighbours, cases, policy).join(seeds.select(F.col("query_key").alias("name"), "reference_function_name"), "name", "left")
    anchor = F.col("reference_function_name")
    if policy.allow_visible_names:
        known = names.select("name", F.lit(True).alias("__known"))
        rows = rows.join(known, "name", "left")
        anchor = F.coalesce(anchor, F.when(F.col("__known") & ~has_prefix("name", policy.exclude_prefixes), F.col("name")))
    source = F.when(F.col("reference_function_name").isNotNull(), "seed_anchor").otherwise("visible_reference_name_anchor")
    found = rows.select("case_id", "relation", "pos", F.col("name").alias("query_name"), anchor.alias("anchor"), source.alias("source")).where("anchor is not null")
    return _first_by(found, "anchor")
