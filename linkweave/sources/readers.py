"""Feature trees and JSON documents as DataFrames (A1 to A10)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.functions.names import normalized_architecture, truthy
from linkweave.policy import Policy
from linkweave.sources import arrays, schemas

# Directory names that make up an environment.
ARCHITECTURES = ("aarch64", "arm64", "x86_64")
STRIP_MODES = ("nostrip", "stripped")


def resolve_path(path: str, base: str) -> str:
    """A5: absolute paths and URLs stay, others are below base."""
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"


def environment(parts: Column) -> tuple[Column, dict[str, Column]]:
    """Whether the parts of a relative path name a feature file, and the environment that they name."""
    at = {n: F.get(parts, F.lit(k)) for k, n in enumerate(("lua_version", "arch", "opt_level", "strip_mode"))}
    fits = (F.size(parts) >= 5) & at["lua_version"].startswith("Lua_") & at["arch"].isin(*ARCHITECTURES) & at["opt_level"].startswith("O") & at["strip_mode"].isin(*STRIP_MODES)
    return fits, {"lua_version": at["lua_version"], "architecture": normalized_architecture(at["arch"]), "opt_level": at["opt_level"], "strip_mode": at["strip_mode"]}


def feature_paths(spark: SparkSession, root: str) -> DataFrame:
    """source_json (relative), path parts and environment of each feature file, ordered by path components."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select("path")
    return _with_environment(files, "path", root).select("source_json", "path_parts", "lua_version", "architecture", "opt_level", "strip_mode").orderBy("path_parts")


def _with_environment(files: DataFrame, path: str, root: str) -> DataFrame:
    relative = F.substring_index(F.col(path), root.rstrip("/") + "/", -1)
    fits, env = environment(F.split(relative, "/"))
    return files.withColumn("source_json", relative).withColumn("path_parts", F.split(relative, "/")).where(fits).withColumns(env)


def read_features(spark: SparkSession, root: str, whole: int = 32 << 20) -> DataFrame:
    """A3: one row for each element of each feature file, with row (its place) and the file's environment.

    A file of up to `whole` bytes is read by one task, a larger one by many (sources.arrays); the rows are the same. A file that is
    not a JSON array raises an error. The environment is the path's; the row's own architecture and version, which a summary shows
    unchanged, are feature_architecture and feature_lua_version."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    raw = texts.text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_size").alias("__bytes")).where(F.col("__bytes") <= whole)
    files = _with_environment(raw, "__path", root)
    kind = f"array<struct<{_struct(schemas.FEATURES)}>>"
    text = F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")
    broken = F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("source_json"))).cast(kind)
    rows = F.when(text.startswith("["), F.coalesce(F.from_json(text, kind), broken)).otherwise(broken)
    about = ("source_json", "path_parts", "lua_version", "architecture", "opt_level", "strip_mode")
    found = files.select(*about, F.posexplode(rows).alias("row", "f"))
    large = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).where(F.col("length") > whole)
    if not large.select("path").isEmpty():
        split = arrays.elements(_with_environment(arrays.pieces(spark, root, whole), "path", root).select("path", "block", "id", "text"))
        found = found.unionByName(_with_environment(split, "path", root).select(*about, "row", F.from_json("element", f"struct<{_struct(schemas.FEATURES)}>").alias("f")))
    own = [F.col(f"f.{c}").alias({"architecture": "feature_architecture", "lua_version": "feature_lua_version"}.get(c, c)) for c in [x.strip().split(" ")[0] for x in _split(schemas.FEATURES)]]
    return found.select(*about, "row", *own)


def _split(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[start:k])
            start = k + 1
    return [*parts, ddl[start:]]


def _struct(ddl: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ", 1) for x in _split(ddl)))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A4: a JSON document, one row."""
    return spark.read.schema(schema).json(path, multiLine=True)


class Document:
    """A4: a JSON document whose arrays of objects are read by entry: one of up to `whole` bytes by one task, a larger one by many (sources.arrays); the rows are the same."""

    def __init__(self, spark: SparkSession, path: str, whole: int = 32 << 20) -> None:
        self.spark, self.path = spark, path
        sizes = spark.read.format("binaryFile").load(path).select("length")
        self._split = arrays.document(arrays.document_pieces(spark, path)) if not sizes.where(F.col("length") > whole).isEmpty() else None

    def entries(self, field: str, schema: str) -> DataFrame:
        """pos and e of each entry of one array; schema: of an entry, as a type."""
        if self._split is None:
            return read_document(self.spark, self.path, f"{field} ARRAY<{schema}>").select(F.posexplode(field).alias("pos", "e"))
        return self._split[0].where(F.col("field") == field).select("pos", F.from_json("element", schema).alias("e"))

    def header(self, schema: str) -> DataFrame:
        """One row, of the fields that are no such arrays."""
        if self._split is None:
            return read_document(self.spark, self.path, schema)
        kind = f"struct<{_struct(schema)}>"
        return self._split[1].select(F.from_json("value", kind).alias("d")).select("d.*")


def _entry(schema: str, field: str) -> str:
    """The type of an entry of one array in a document's schema."""
    kinds = dict(x.strip().split(" ", 1) for x in _split(schema))
    return kinds[field].removeprefix("ARRAY<").removesuffix(">")


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """M8: query_id, query_name, query_pos, architecture, pos, name, prior, rank; queries without candidates have a null pos."""
    q = Document(spark, path).entries("queries", _entry(schemas.RETRIEVAL, "queries")).toDF("query_pos", "q")
    rows = q.select("query_pos", F.col("q.query_function_id").alias("query_id"), F.col("q.query_function_name").alias("query_name"), F.col("q.metadata.architecture").alias("architecture"), F.posexplode_outer("q.candidates").alias("pos", "c"))
    return rows.select("query_pos", "query_id", "query_name", "architecture", "pos", F.col("c.candidate_function_name").alias("name"), F.col("c.score_total").alias("prior"), F.col("c.rank").alias("rank"))


def read_query_edges(spark: SparkSession, path: str) -> DataFrame:
    return Document(spark, path).entries("edges", _entry(schemas.GRAPH, "edges")).select("e.*")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """M9: the mappings with pos, their place in the file."""
    return Document(spark, path).entries("mappings", _entry(schemas.ANCHORS, "mappings")).select("pos", "e.*")


def read_suite(spark: SparkSession, path: str, **changes: object) -> tuple[Policy, DataFrame]:
    """Policy and suite cases (case_id, expected_function, suite_pos); changes, as from a command line, beat the suite."""
    suite = Document(spark, path)
    row = suite.header(", ".join(x.strip() for x in _split(schemas.SUITE) if not x.strip().startswith("cases "))).first()
    plain = row.asDict(recursive=True) if row else {}
    anchor, expansion, scoring, decision = (plain.get(k) or {} for k in ("anchor_policy", "candidate_expansion", "scoring", "classification_policy"))
    given = {
        "output_top_candidates": plain.get("output_top_candidates"), "allow_visible_names": anchor.get("allow_visible_reference_name_anchors"), "exclude_prefixes": anchor.get("exclude_prefixes") and tuple(anchor["exclude_prefixes"]),
        "expansion_enabled": expansion.get("enabled"), "expansion_prior": expansion.get("default_prior"), "expansion_limit": expansion.get("max_candidates_per_case"),
        "primary_opt": scoring.get("primary_opt"), "strip_mode": scoring.get("strip_mode"), **decision,
    }
    policy = Policy(**({k: v for k, v in given.items() if v is not None} | changes))
    return policy, suite.entries("cases", _entry(schemas.SUITE, "cases")).select(F.col("pos").alias("suite_pos"), "e.case_id", "e.expected_function")


def read_cases(spark: SparkSession, path: str, candidate_source: str = "unique_topk_preview") -> tuple[DataFrame, DataFrame]:
    """M8 and A10: cases (the last one of an id) and their candidates (case_id, pos, name, prior)."""
    cases = Document(spark, path).entries("cases", _entry(schemas.CASES.format(source=candidate_source), "cases")).toDF("n", "c")
    last = Window.partitionBy("c.case_id").orderBy(F.desc("n"))
    cases = cases.withColumn("k", F.row_number().over(last)).where("k = 1")
    candidates = cases.select("c.case_id", F.posexplode(f"c.{candidate_source}").alias("pos", "x")).select("case_id", "pos", F.col("x.function_name").alias("name"), F.col("x.score_total").alias("prior"))
    return cases.select("c.case_id", "c.mode", "c.query_file", "c.query_func", "c.expected_function"), candidates


def first_features(features: DataFrame) -> DataFrame:
    """The first row of each (source_json, function_name)."""
    first = Window.partitionBy("source_json", "function_name").orderBy("row")
    return features.where(truthy("function_name")).withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def bind_cases(suite_cases: DataFrame, cases: DataFrame, features: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """Suite cases with their query's environment, and their neighbours (case_id, relation, pos, name).

    A suite case without a retrieval case, or without a feature row, raises an error when it is read."""
    own = cases.select("case_id", "mode", "query_file", "query_func", F.col("expected_function").alias("__expected"), F.lit(True).alias("__case"))
    feature = first_features(features).select(F.col("source_json").alias("query_file"), F.col("function_name").alias("query_func"), F.col("feature_architecture").alias("__arch"), F.col("feature_lua_version").alias("__version"), "callees", "callers", F.lit(True).alias("__feature"))
    bound = suite_cases.join(own, "case_id", "left").join(feature, ["query_file", "query_func"], "left")
    checked = F.when(F.col("__case") & F.col("__feature"), F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("no retrieval case or feature row for "), F.col("case_id"))))
    arch = F.coalesce("__arch", F.lit("x86_64"))
    bound = bound.select(checked.alias("case_id"), "mode", "query_file", "query_func", (normalized_architecture(arch) if policy.normalize_architecture else arch).alias("architecture"), F.coalesce("__version", F.lit(policy.lua_version)).alias("lua_version"), F.coalesce("expected_function", "__expected").alias("expected_function"), "callees", "callers")
    sides = F.array(F.struct(F.lit("callee").alias("relation"), F.col("callees").alias("names")), F.struct(F.lit("caller").alias("relation"), F.col("callers").alias("names")))
    neighbours = bound.select("case_id", F.explode(sides).alias("s")).select("case_id", "s.relation", F.posexplode("s.names").alias("pos", "name"))
    return bound.drop("callees", "callers"), neighbours


def parse_expected(spark: SparkSession, items: Iterable[str]) -> DataFrame:
    """ID=NAME, cut at the first =; the last of an id wins, a missing = is an error."""
    found: dict[str, str] = {}
    for item in items:
        key, sign, name = item.partition("=")
        if not sign:
            raise ValueError(f"expected ID=NAME, not {item!r}")
        found[key] = name
    return spark.createDataFrame(list(found.items()), "query_id string, expected_function string")
