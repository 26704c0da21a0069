"""Review records of cases that were not accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.features import feature_summary
from linkweave.functions.names import role_hint

# What a status reason means, and what to do in each review category.
REASONS = {
    "low_score_margin": "Top candidates are too close to safely accept one mapping.",
    "multiple_candidates_same_final_score": "Multiple candidates share the same final score.",
    "no_anchor_evidence": "No accepted caller/callee anchor supports this mapping.",
    "insufficient_primary_graph_matches": "The best candidate lacks primary O0 graph evidence.",
    "duplicate_accepted_mapping_in_query_scope": "More than one query function maps to the same reference function.",
    "no_candidates": "No retrieval or graph-expanded candidates are available.",
}
UNKNOWN_REASON = "No description available."
ACTIONS = {
    "ambiguous_candidate_tie": "Compare the tied candidates with local function features or send this record to the Local LLM analyst layer for semantic disambiguation.",
    "needs_more_graph_anchors": "Do not accept automatically. First propagate additional high-confidence caller/callee anchors, then re-run graph scoring.",
    "mapping_conflict": "Resolve one-to-one mapping conflict before accepting either candidate.",
    "manual_review": "Keep deferred and inspect manually.",
}
PAYLOAD_VERSION = "0.2"
# Fixed value: the classes of an answer.
CLASSES = "prefer_candidate | remain_deferred | need_more_anchors | possible_custom"


def category(reasons: Column | str) -> Column:
    """I8: the first rule that a reason meets."""
    has = lambda *names: F.arrays_overlap(F.col(reasons) if isinstance(reasons, str) else reasons, F.array(*map(F.lit, names)))
    return F.when(has("multiple_candidates_same_final_score", "low_score_margin"), "ambiguous_candidate_tie").when(has("no_anchor_evidence"), "needs_more_graph_anchors").when(has("duplicate_accepted_mapping_in_query_scope"), "mapping_conflict").otherwise("manual_review")


def action(of: Column | str) -> Column:
    """The advice for a category."""
    known = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.element_at(known, F.col(of) if isinstance(of, str) else of)


def described(reasons: Column | str) -> Column:
    """(reason, description) of each status reason."""
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.transform(reasons, lambda r: F.struct(r.alias("reason"), F.coalesce(F.try_element_at(known, r), F.lit(UNKNOWN_REASON)).alias("description")))


def margin(top: Column | str) -> Column:
    """Rounded distance of the two best final scores; null with fewer than two."""
    score = lambda k: F.get(top, F.lit(k))["final_score"]
    return F.round(score(0) - score(1), 6)


def compact_candidates(ranked: DataFrame, n: int) -> DataFrame:
    """The first n candidates of each case as one array, with role hints and five pieces of evidence."""
    one = F.struct(
        F.col("final_rank").alias("rank"), F.col("name").alias("function_name"), role_hint("name").alias("role_hint"), F.col("candidate_source").alias("source"), F.col("prior").alias("retrieval_prior"),
        "graph_score", "final_score", "primary_matches", "auxiliary_matches", "missing_anchor_edges", F.slice("evidence", 1, 5).alias("evidence"),
    )
    return ranked.where(F.col("final_rank") <= n).groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("top_candidates"))


ITEMS = "array<struct<query_neighbor_name:string,reference_function_name:string,source:string>>"


def anchor_items(anchors: DataFrame, most: int = 30) -> DataFrame:
    """case_id, callee_anchors, caller_anchors: the first anchors of each side, each with the neighbour's own name and where its mapping is from."""
    item = F.struct("pos", F.col("query_name").alias("query_neighbor_name"), F.col("anchor").alias("reference_function_name"), "source")
    listed = lambda r: F.slice(F.array_sort(F.collect_list(F.when(F.col("relation") == r, item))), 1, most)
    plain = lambda x: F.struct(x["query_neighbor_name"].alias("query_neighbor_name"), x["reference_function_name"].alias("reference_function_name"), x["source"].alias("source"))
    return anchors.groupBy("case_id").agg(*[F.transform(listed(r), plain).alias(f"{r}_anchors") for r in ("callee", "caller")])


def to_review(results: DataFrame) -> DataFrame:
    """What was deferred or is in conflict."""
    return results.where(F.col("status").isin("deferred", "conflict"))


def review_cases(results: DataFrame, ranked: DataFrame, anchors: DataFrame, features: DataFrame, n: int = 5) -> DataFrame:
    """A record for each case to review. features: first rows of (query_file, query_func), with their environment as written."""
    sides = anchor_items(anchors)
    summary = features.select("query_file", "query_func", feature_summary(F.lit(True)).alias("query_feature_summary"))
    rows = to_review(results).join(compact_candidates(ranked, n), "case_id", "left").join(sides, "case_id", "left").join(summary, ["query_file", "query_func"], "left")
    empty = F.array().cast(ITEMS)
    rows = rows.withColumn("review_category", category("status_reasons"))
    counts = F.struct(F.col("callee_anchor_count").alias("callee"), F.col("caller_anchor_count").alias("caller"))
    payload = F.struct(
        F.lit(PAYLOAD_VERSION).alias("schema_version"), F.lit("Decide whether the evidence favours one candidate for this function, or whether the case should stay deferred.").alias("task"),
        F.lit("query_func and expected_function may be debug labels; judge by features, retrieval and graph evidence alone.").alias("label_leakage_warning"),
        F.col("query_func").alias("query_function"), "query_feature_summary", F.col("status_reasons").alias("deferred_reasons"), F.col("top_candidates").alias("candidate_summaries"),
        F.struct("callee_anchor_count", "caller_anchor_count", "top_tied_candidates").alias("graph_anchor_summary"),
        F.struct(F.lit(CLASSES).alias("classification"), F.lit("name of a candidate, or null").alias("recommended_candidate"), F.lit("from 0.0 to 1.0").alias("confidence"), F.array(F.lit("what speaks for it")).alias("reasoning_summary"), F.array(F.lit("what may be wrong")).alias("risks")).alias("answer_format"),
    )
    return rows.select(
        "case_id", "query_file", "query_func", "architecture", "expected_function", F.col("predicted_function_name").alias("current_top_prediction"), "expected_final_rank", "status", "review_category",
        described("status_reasons").alias("status_reasons"), action("review_category").alias("recommended_action"), margin("top_candidates").alias("score_margin_top1_top2"), "top_tied_candidates", counts.alias("anchor_counts"),
        F.struct(F.coalesce("callee_anchors", empty).alias("callees"), F.coalesce("caller_anchors", empty).alias("callers")).alias("anchors"),
        F.struct(F.col("candidate_count").alias("total"), F.col("retrieval_candidate_count").alias("retrieval"), F.col("expanded_candidate_count").alias("expanded")).alias("candidate_counts"),
        "query_feature_summary", "top_candidates", payload.alias("llm_payload"),
    )


def category_counts(results: DataFrame) -> DataFrame:
    """H5."""
    return to_review(results).groupBy(category("status_reasons").alias("review_category")).count().withColumnRenamed("count", "cases")


def review_summary(records: DataFrame) -> DataFrame:
    """H6."""
    return records.agg(F.count_if(F.col("status") == "deferred").alias("deferred_cases"), F.count_if(F.col("status") == "conflict").alias("conflict_cases"), F.count_if(F.col("query_feature_summary").isNotNull()).alias("features_attached"))


def human_report(records: DataFrame) -> DataFrame:
    """X8, an extension: records in order of priority: conflicts, then ties, then what lacks anchors, then the rest."""
    priority = F.when(F.col("status") == "conflict", 1).when(F.col("review_category") == "ambiguous_candidate_tie", 2).when(F.col("review_category") == "needs_more_graph_anchors", 3).otherwise(4)
    return records.withColumn("review_priority", priority).orderBy("review_priority", "case_id")

