"""Documented by the blueprint, not part of its inventory of implemented operators (X1 to X8 and X10; X9 is in operators.store)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.checkpoints import discard, tabled
from linkweave.functions.names import truthy
from linkweave.policy import Policy


def validation_issues(functions: DataFrame, edges: DataFrame, candidates: DataFrame, mappings: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Rule and number of rows that break it: repeated ids, loose ends of edges, repeated candidates, scores and confidences outside 0 to 1, anchors
    that are not accepted, and documents (name, schema_version) without a version."""
    each = []

    def told(counts: DataFrame) -> None:
        """One row of counts, a column for each rule, as rows."""
        rules = ", ".join(f"'{c}', coalesce({c}, 0L)" for c in counts.columns)
        each.append(counts.selectExpr(f"stack({len(counts.columns)}, {rules}) AS (rule, rows)"))

    outside = lambda c: F.count_if(~F.col(c).between(0.0, 1.0))
    # each table is read once: rules of rows are counted beside what is grouped, and ids meet the edges' ends in one grouping
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"), F.lit(0).alias("own"), F.lit(1).alias("end"))
    ids = functions.select(F.col("function_id").alias("id"), F.lit(1).alias("own"), F.lit(0).alias("end")).unionByName(ends).groupBy("id").agg(F.sum("own").alias("own"), F.sum("end").alias("ends"))
    told(ids.agg(F.count_if(F.col("own") > 1).alias("function_id_unique"), F.sum(F.when((F.col("own") == 0) | F.col("id").isNull(), F.col("ends"))).alias("edge_ends_exist")))
    names = candidates.groupBy("case_id", "name").agg(F.count("*").alias("n"), outside("prior").alias("wrong"))
    told(names.agg(F.count_if(F.col("n") > 1).alias("candidate_names_unique"), F.sum("wrong").alias("score_in_range")))
    told(mappings.agg(F.count_if(~F.col("status").eqNullSafe("accepted")).alias("anchors_accepted"), *[outside(c).alias("confidence_in_range") for c in ("confidence",) if c in mappings.columns]))
    if documents is not None:
        told(documents.agg(F.count_if(~truthy("schema_version")).alias("schema_version_given")))
    return functools.reduce(DataFrame.unionByName, each)


def anchor_selection(candidates: DataFrame, score: float = 0.9, margin: float = 0.05) -> DataFrame:
    """Whether a case's best candidate is good and clear enough to be an anchor."""
    order = Window.partitionBy("case_id").orderBy(F.desc("prior"), "name")
    rows = candidates.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("prior").over(order)).where("k = 1")
    clear = (F.col("prior") >= score) & (F.col("prior") - F.coalesce("second", F.lit(0.0)) >= margin)
    return rows.select("case_id", "name", "prior", F.when(clear, "anchor_candidate").otherwise("ambiguous").alias("decision"))


def strict_policy(**changes: object) -> Policy:
    """Heavier weights, and a bonus for each anchor that a candidate both calls and is called by."""
    return Policy(**({"primary_bonus": 0.05, "auxiliary_bonus": 0.05, "missing_penalty": 0.1, "mutual_bonus": 0.03} | changes))


def conflicts_by_margin(results: DataFrame, policy: Policy) -> DataFrame:
    """Of accepted results with one file and prediction the one with the larger margin stays, if that margin suffices; the others are deferred."""
    results = results.withColumn("margin", F.round(F.col("top_score") - F.coalesce("second_score", F.lit(0.0)), 6))
    scope = ["query_file", "predicted_function_name"]
    # accepted ones alone are rivals, and the best of each group is an aggregate: cases without a prediction never meet
    rivals = results.where((F.col("status") == "accepted") & truthy("predicted_function_name")).groupBy(*scope).agg(F.count("*").alias("rivals"), F.min(F.struct((-F.col("margin")).alias("m"), "case_id")).alias("best"))
    rivals = rivals.where("rivals > 1").select(F.col("query_file").alias("__file"), F.col("predicted_function_name").alias("__name"), "rivals", F.col("best.case_id").alias("__winner"))
    met = F.col("query_file").eqNullSafe(F.col("__file")) & (F.col("predicted_function_name") == F.col("__name")) & (F.col("status") == "accepted")
    wins = (F.col("case_id") == F.col("__winner")) & (F.col("margin") >= policy.accept_margin)
    joined = results.join(rivals, met, "left")
    return joined.withColumn("resolved_status", F.when(F.col("rivals").isNotNull() & ~wins, "deferred").otherwise(F.col("status"))).drop("__file", "__name", "__winner")


def propagate(step: Callable[[DataFrame], DataFrame], seeds: DataFrame) -> tuple[DataFrame, int]:
    """Runs step(seeds) -> results, adds what was accepted to the seeds, and goes on until nothing is added: each round adds a query key at
    least, so it ends. The number of rounds is returned too.

    Each round's seeds are written to the shared checkpoint folder; a count alone reaches the driver."""
    known = tabled(seeds.select("query_key", "reference_function_name").distinct())
    n, rounds = known.count(), 0
    while True:
        rounds += 1
        was, known, last = n, tabled(_grown(step(known), known)), known
        discard(last)
        n = known.count()
        if n == was:
            return known, rounds


def _grown(results: DataFrame, known: DataFrame) -> DataFrame:
    """The known keys and those that results accept besides."""
    found = results.where(F.col("status") == "accepted").select(F.col("query_func").alias("query_key"), F.col("predicted_function_name").alias("reference_function_name"))
    fresh = found.where(truthy("query_key")).groupBy("query_key").agg(F.min("reference_function_name").alias("reference_function_name")).join(known, "query_key", "left_anti")
    return known.unionByName(fresh)


def mapping_export(results: DataFrame, ranked: DataFrame | None = None, advice: DataFrame | None = None) -> DataFrame:
    """case_id, status and mapping, a JSON document for each case: the final candidate, its scores and evidence, the cases that it is in conflict
    with, and what a language model said of it (llm_evidence; it changes nothing else). Cases without candidates are `rejected`.

    ranked gives scores and evidence; advice (case_id, analysis: JSON text) is as of operators.analyst.ask()."""
    status = F.when(F.array_contains("status_reasons", "no_candidates"), "rejected").otherwise(F.col("status"))
    rows = results.withColumn("__status", status)
    clash = rows.where("status = 'conflict'").select("query_file", "predicted_function_name", F.col("query_func").alias("__other"))
    # a conflict's group is as large as the cases that were accepted for one name of one file
    others = clash.groupBy("query_file", "predicted_function_name").agg(F.array_sort(F.collect_list("__other")).alias("__others"))
    rows = rows.join(others, ["query_file", "predicted_function_name"], "left")
    conflicts = F.when(F.col("status") == "conflict", F.array_remove("__others", F.col("query_func"))).otherwise(F.array().cast("array<string>"))
    if ranked is not None:
        best = ranked.where("final_rank = 1").select("case_id", F.struct(F.col("prior").alias("retrieval_prior"), "graph_score", "final_score").alias("__scores"), F.col("evidence").alias("__evidence"))
        rows = rows.join(best, "case_id", "left")
    if advice is not None:
        rows = rows.join(advice.select("case_id", F.col("analysis").alias("__advice")), "case_id", "left")
    get = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    mapping = F.struct(
        F.col("query_func").alias("query_function_id"), "query_file", F.struct(F.col("predicted_function_name").alias("reference_function_name")).alias("final_candidate"), F.col("__status").alias("status"), F.col("top_score").alias("confidence"),
        get("__scores", "struct<retrieval_prior:double,graph_score:double,final_score:double>").alias("scores"), F.coalesce(get("__evidence", "array<string>"), F.array().cast("array<string>")).alias("evidence"), "status_reasons",
        conflicts.alias("conflicts"), F.try_parse_json(get("__advice", "string")).alias("llm_evidence"),
    )
    return rows.select("case_id", F.col("__status").alias("status"), F.to_json(mapping, {"ignoreNullFields": "false"}).alias("mapping"))


def unanchored_neighbours(neighbours: DataFrame, anchors: DataFrame) -> DataFrame:
    """case_id and custom_suspected: whether a case calls, or is called by, a named function that no anchor stands for."""
    known = anchors.select("case_id", "relation", F.col("query_name").alias("name")).distinct()
    loose = neighbours.where(truthy("name")).join(known, ["case_id", "relation", "name"], "left_anti")
    return loose.select("case_id").distinct().withColumn("custom_suspected", F.lit(True))


def review_triggers(results: DataFrame, policy: Policy, custom: DataFrame | None = None) -> DataFrame:
    """case_id and triggers: why a model should look at a case: it is deferred, other accepted cases claim its name (conflict_count over 0), its margin is
    small, or it is suspected to be a function of the query's own (custom: unanchored_neighbours())."""
    claims = results.where(F.col("status").isin("accepted", "conflict")).groupBy("query_file", "predicted_function_name").agg(F.count("*").alias("__claims"))
    rows = results.join(claims, ["query_file", "predicted_function_name"], "left").withColumn("conflict_count", F.when(F.col("status").isin("accepted", "conflict"), F.col("__claims") - 1).otherwise(0))
    if custom is not None:
        rows = rows.join(custom, "case_id", "left")
    suspected = F.coalesce(F.col("custom_suspected"), F.lit(False)) if "custom_suspected" in rows.columns else F.lit(False)
    margin = F.col("top_score") - F.coalesce("second_score", F.lit(0.0))
    rules = (("deferred", F.col("status") == "deferred"), ("conflict", F.col("conflict_count") > 0), ("low_margin", margin < policy.accept_margin), ("custom_suspected", suspected))
    why = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))
    return rows.select("case_id", why.alias("triggers")).where(F.size("triggers") > 0)
