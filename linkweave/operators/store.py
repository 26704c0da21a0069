"""The reference graph: functions, edges, and what is seen of an edge at which optimisation level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.checkpoints import tabled
from linkweave.functions.names import function_id, truthy
from linkweave.policy import ENV

LEVELS = (*ENV[:2], "opt_level", ENV[2])


def _first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def _named(features: DataFrame) -> DataFrame:
    return features.where(truthy("function_name")).withColumn("src_id", function_id("ref", "function_name", *LEVELS))


def calls(features: DataFrame) -> DataFrame:
    """Every call of every named row, before any is dropped: dst_id is the callee's id here if the file has it, else an external one."""
    rows = _named(features)
    callees = F.array_sort(F.array_distinct(F.filter(F.coalesce("callees", F.array().cast("array<string>")), lambda x: truthy(x))))
    each = rows.select("source_json", "path_parts", "row", *LEVELS, F.col("function_name").alias("src_name"), F.explode(callees).alias("dst_name"))
    internal = rows.select("source_json", F.col("function_name").alias("dst_name")).distinct().withColumn("internal", F.lit(True))
    joined = each.join(internal, ["source_json", "dst_name"], "left")
    known = F.coalesce("internal", F.lit(False))
    # ids are made of the names behind the join, which need not carry them
    return joined.withColumn("internal", known).withColumn("src_id", function_id("ref", "src_name", *LEVELS)).withColumn("dst_id", F.when(F.col("internal"), function_id("ref", "dst_name", *LEVELS)).otherwise(function_id("external", "dst_name", *LEVELS)))


def functions(features: DataFrame, called: DataFrame | None = None) -> DataFrame:
    """Vertices, the first of an id in the order of path components and rows. called: calls(features), if they are there already."""
    own = _named(features).select(F.col("src_id").alias("function_id"), "function_name", F.lit("reference").alias("graph_role"), *LEVELS, "entry_point", "source_json", "path_parts", "row")
    external = (calls(features) if called is None else called).where(~F.col("internal")).select(F.col("dst_id").alias("function_id"), F.col("dst_name").alias("function_name"), F.lit("reference_external").alias("graph_role"), *LEVELS, F.lit(None).cast("string").alias("entry_point"), "source_json", "path_parts", "row")
    return _first(own.unionByName(external), ["function_id"], ["path_parts", "row"]).drop("path_parts", "row")


def edges(features: DataFrame, called: DataFrame | None = None) -> DataFrame:
    """Edges, the first of each key."""
    rows = (calls(features) if called is None else called).select("src_id", "dst_id", "src_name", "dst_name", F.lit("calls").alias("edge_type"), F.lit("reference").alias("graph_role"), *LEVELS, "source_json", "path_parts", "row")
    return _first(rows, ["src_id", "dst_id", "edge_type", "graph_role", *LEVELS], ["path_parts", "row", "dst_name"]).drop("path_parts", "row")


def build_counts(features: DataFrame, called: DataFrame | None = None) -> DataFrame:
    """Functions, edges and external calls of each environment, before rows of one key are dropped."""
    named = _named(features).groupBy(*LEVELS).agg(F.count("*").alias("functions"))
    called = (calls(features) if called is None else called).groupBy(*LEVELS).agg(F.count("*").alias("edges"), F.count_if(~F.col("internal")).alias("external_calls"))
    zero = F.lit(0).cast("long")
    return named.join(called, list(LEVELS), "left").select(*LEVELS, "functions", F.coalesce("edges", zero).alias("edges"), F.coalesce("external_calls", zero).alias("external_calls"))


def query_adjacency(query_edges: DataFrame) -> DataFrame:
    """Distinct calls of a query graph, without rows that lack an end; serves both directions."""
    kept = query_edges.where((F.coalesce("edge_type", F.lit("calls")) == "calls") & truthy("src") & truthy("dst"))
    return kept.select("src", "dst").distinct()


def query_graph(query_edges: DataFrame, lua_version: str, architecture: str, opt_level: str, strip_mode: str, source: str) -> tuple[DataFrame, DataFrame]:
    """X9, an extension: a query graph as functions and edges of a store, with the role `query` and edges of any type. What asks for the
    role `reference` doesn't see them."""
    env = {"lua_version": lua_version, "architecture": architecture, "opt_level": opt_level, "strip_mode": strip_mode}
    # written, as its source may be a document and is read twice below
    kept = tabled(query_edges.where(truthy("src") & truthy("dst")).select("src", "dst", F.coalesce("edge_type", F.lit("calls")).alias("edge_type")).distinct())
    names = kept.select(F.explode(F.array("src", "dst")).alias("function_name")).distinct()
    columns = [F.lit(env[c]).alias(c) for c in LEVELS]
    functions = names.select(F.concat(F.lit("query::"), "function_name").alias("function_id"), "function_name", F.lit("query").alias("graph_role"), *columns, F.lit(None).cast("string").alias("entry_point"), F.lit(source).alias("source_json"))
    ids = [F.concat(F.lit("query::"), c).alias(n) for n, c in (("src_id", "src"), ("dst_id", "dst"))]
    return functions, kept.select(*ids, F.col("src").alias("src_name"), F.col("dst").alias("dst_name"), "edge_type", F.lit("query").alias("graph_role"), *columns, F.lit(source).alias("source_json"))


def stored_query_edges(edges: DataFrame) -> DataFrame:
    """The query graph of a store, as query_adjacency() and the scorer read it."""
    return edges.where(F.col("graph_role") == "query").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "edge_type")


def reference_names(functions: DataFrame) -> DataFrame:
    """Names with the role reference, over all environments."""
    return functions.where(F.col("graph_role") == "reference").select(F.col("function_name").alias("name")).distinct()


def pair_levels(edges: DataFrame, strip_mode: str = "nostrip", edge_types: tuple[str, ...] = ("calls",)) -> DataFrame:
    """The optimisation levels at which each call is seen, sorted. Edges of other types (X9) count if they are asked for."""
    rows = edges.where((F.col("graph_role") == "reference") & (F.col("strip_mode") == strip_mode) & F.col("edge_type").isin(*edge_types))
    return rows.groupBy("lua_version", "architecture", "src_name", "dst_name").agg(F.array_sort(F.collect_set("opt_level")).alias("opt_levels"))


def all_pair_levels(edges: DataFrame) -> DataFrame:
    """pair_levels() of calls in every strip mode, which is a column."""
    rows = edges.where((F.col("graph_role") == "reference") & (F.col("edge_type") == "calls"))
    return rows.groupBy("lua_version", "architecture", "strip_mode", "src_name", "dst_name").agg(F.array_sort(F.collect_set("opt_level")).alias("opt_levels"))


@dataclass(frozen=True)
class Pairs:
    """Pairs with their levels, as stored twice: dealt by callee and by caller."""

    by_callee: DataFrame
    by_caller: DataFrame


def pairs_at(pairs: DataFrame | Pairs, end: str) -> DataFrame:
    """Pairs for a join on one end, src_name or dst_name."""
    if isinstance(pairs, Pairs):
        return pairs.by_callee if end == "dst_name" else pairs.by_caller
    return pairs


def callees_of(edges: DataFrame, name: str) -> DataFrame:
    """What a function calls."""
    return edges.where(F.col("src_name") == name).select("dst_name", *LEVELS).distinct()


def callers_of(edges: DataFrame, name: str) -> DataFrame:
    """What calls a function."""
    return edges.where(F.col("dst_name") == name).select("src_name", *LEVELS).distinct()
