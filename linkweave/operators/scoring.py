"""Scores of candidates by how their edges agree with the anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.names import truthy
from linkweave.policy import Policy


def graph_score(primary: Column, auxiliary: Column, missing: Column, policy: Policy) -> Column:
    """F3, without rounding; doubles throughout, as thresholds compare sums of them."""
    return primary * F.lit(policy.primary_bonus) + auxiliary * F.lit(policy.auxiliary_bonus) - missing * F.lit(policy.missing_penalty)


def score(candidates: DataFrame, links: DataFrame, pairs: DataFrame, policy: Policy) -> DataFrame:
    """One row for each candidate.

    candidates: case_id, lua_version, architecture, pos, name, prior and more, which is kept. links: case_id, relation (callee or caller),
    pos, anchor (null: not anchored), neighbour. The pairs of candidate and anchor of a case are joined once to the levels at
    which the reference shows their edge, in whichever direction the relation asks for."""
    keys = ["case_id", "pos"]
    env = ["lua_version", "architecture"]
    asked = candidates.select("case_id", *env, "pos", "name").join(links.select("case_id", "relation", F.col("pos").alias("__at"), "anchor", "neighbour"), "case_id")
    down = F.col("relation") == "callee"
    asked = asked.withColumn("src_name", F.when(down, F.col("name")).otherwise(F.col("anchor"))).withColumn("dst_name", F.when(down, F.col("anchor")).otherwise(F.col("name")))
    joined = asked.join(pairs.select(*env, "src_name", "dst_name", "opt_levels"), [*env, "src_name", "dst_name"], "left")
    anchored, found = F.col("anchor").isNotNull(), F.col("opt_levels").isNotNull()
    primary = F.coalesce(anchored & F.array_contains("opt_levels", policy.primary_opt), F.lit(False))
    kinds = joined.select(*keys, "relation", "__at", "neighbour", "src_name", "dst_name", "opt_levels", primary.alias("p"), (anchored & found & ~primary).alias("a"), (anchored & ~found).alias("m"), (~anchored).alias("u"))
    edge = F.concat(F.col("src_name"), F.lit("->"), F.col("dst_name"))
    side = F.col("relation")
    text = F.when(F.col("p"), F.concat(F.lit("primary_"), side, F.lit("_anchor_match:"), edge)).when(F.col("a"), F.concat(F.lit("aux_"), side, F.lit("_anchor_match:"), edge, F.lit(":"), F.array_join("opt_levels", ",")))
    if policy.full_evidence:
        text = text.when(F.col("m"), F.concat(F.lit("missing_"), side, F.lit("_anchor_edge:"), edge)).when(F.col("u"), F.concat(F.lit("unanchored_query_"), side, F.lit(":"), F.col("neighbour")))
    # callees come before callers, each in order of place
    line = F.when(text.isNotNull(), F.struct((side == "caller").alias("second"), F.col("__at").alias("at"), F.col("neighbour").alias("neighbour"), text.alias("text")))
    counted = kinds.groupBy(*keys).agg(F.count_if("p").alias("primary_matches"), F.count_if("a").alias("auxiliary_matches"), F.count_if("m").alias("missing_anchor_edges"), F.count_if("u").alias("unknown_extra_neighbors"), F.array_sort(F.collect_list(line)).alias("__lines"))
    evidence = F.transform(F.col("__lines"), lambda x: x["text"])
    if policy.evidence_limit is not None:
        evidence = F.slice(evidence, 1, policy.evidence_limit)
    rows = candidates.join(counted, keys, "left")
    zero = F.lit(0).cast("long")
    n = {c: F.coalesce(F.col(c), zero) for c in ("primary_matches", "auxiliary_matches", "missing_anchor_edges", "unknown_extra_neighbors")}
    raw = graph_score(n["primary_matches"], n["auxiliary_matches"], n["missing_anchor_edges"], policy)
    return rows.select(
        *[F.col(c) for c in candidates.columns if c != "prior"], F.round("prior", 6).alias("prior"), *[x.alias(c) for c, x in n.items()],
        F.round(raw, 6).alias("graph_score"), F.round(F.col("prior") + raw, 6).alias("final_score"),
        F.coalesce(evidence, F.array().cast("array<string>")).alias("evidence"), (n["unknown_extra_neighbors"] > 0).alias("custom_suspected"),
    )


def score_named(candidates: DataFrame, anchors: DataFrame, policy: Policy) -> DataFrame:
    """F2, F3, F7 for anchors that are known by name: the rows of score(), without evidence, of candidates with their COUNTS (candidates.combined()).

    An anchor without an edge to a candidate is a missing one, so misses are counted by subtraction: the product of candidates and
    anchors is never made."""
    sums = anchors.groupBy("case_id").agg(F.count("*").alias("__anchors"))
    rows = candidates.join(sums, "case_id", "left")
    zero = F.lit(0).cast("long")
    kinds = ["primary_matches", "auxiliary_matches", *["mutual_edge_matches"] * bool(policy.mutual_bonus)]
    n = {c: F.coalesce(F.col(c), zero) for c in kinds}
    n |= {"missing_anchor_edges": F.coalesce("__anchors", zero) - n["primary_matches"] - n["auxiliary_matches"], "unknown_extra_neighbors": zero}
    raw = graph_score(n["primary_matches"], n["auxiliary_matches"], n["missing_anchor_edges"], policy)
    if policy.mutual_bonus:
        raw = raw + n["mutual_edge_matches"] * F.lit(policy.mutual_bonus)
    own = [c for c in candidates.columns if c != "prior" and c not in n]
    return rows.select(*[F.col(c) for c in own], F.round("prior", 6).alias("prior"), *[x.alias(c) for c, x in n.items()], F.round(raw, 6).alias("graph_score"), F.round(F.col("prior") + raw, 6).alias("final_score"), F.lit(False).alias("custom_suspected"))


def _line(src: str | Column, dst: str | Column, policy: Policy) -> Column:
    """A piece of evidence, of an edge of candidates.support(), with what it is ordered by: callees before callers, each in order of place."""
    edge = F.concat(src, F.lit("->"), dst)
    primary = F.array_contains("opt_levels", policy.primary_opt)
    text = F.when(primary, F.concat(F.lit("primary_"), "relation", F.lit("_anchor_match:"), edge)).otherwise(F.concat(F.lit("aux_"), "relation", F.lit("_anchor_match:"), edge, F.lit(":"), F.array_join("opt_levels", ",")))
    return F.struct((F.col("relation") == "caller").alias("second"), F.col("pos").alias("at"), "neighbour", text.alias("text"))


def _texts(lines: str, policy: Policy) -> Column:
    texts = F.transform(F.array_sort(lines), lambda x: x["text"])
    return texts if policy.evidence_limit is None else F.slice(texts, 1, policy.evidence_limit)


def all_evidence(told: DataFrame, policy: Policy) -> DataFrame:
    """the rows of candidates.edges_of_rows() with all of their evidence."""
    down = F.col("relation") == "callee"
    src, dst = F.when(down, F.col("name")).otherwise(F.col("anchor")), F.when(down, F.col("anchor")).otherwise(F.col("name"))
    line = F.when(F.col("opt_levels").isNotNull(), _line(src, dst, policy))
    met = told.groupBy("case_id", "name").agg(F.collect_list("row").alias("rows"), F.collect_list(line).alias("__lines")).where(F.size("rows") > 0)
    # rows of one name have each met the hubs
    met = met.withColumn("__lines", F.array_distinct("__lines"))
    return met.select(F.explode("rows").alias("r"), _texts("__lines", policy).alias("evidence")).select("r.*", "evidence")


def with_evidence(rows: DataFrame, found: DataFrame, policy: Policy) -> DataFrame:
    """scored candidates with their evidence, callees before callers, each in order of place. found: candidates.support().

    Evidence is gathered for these rows alone, so for those that are shown and not for all that were scored."""
    told = found.join(rows.select("case_id", "name").distinct(), ["case_id", "name"], "left_semi").groupBy("case_id", "name").agg(F.collect_list(_line("src_name", "dst_name", policy)).alias("__lines"))
    evidence = _texts("__lines", policy)
    return rows.join(told, ["case_id", "name"], "left").select(*rows.columns, F.coalesce(evidence, F.array().cast("array<string>")).alias("evidence"))


def id_links(queries: DataFrame, adjacency: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links of each query's distinct neighbours by id; those without an anchor have a null one. Self loops stay, in both directions."""
    down = adjacency.select(F.col("src").alias("case_id"), F.lit("callee").alias("relation"), F.col("dst").alias("neighbour"))
    up = adjacency.select(F.col("dst").alias("case_id"), F.lit("caller").alias("relation"), F.col("src").alias("neighbour"))
    rows = down.unionByName(up).join(queries.select("case_id").distinct(), "case_id", "left_semi")
    named = anchors.where(truthy("reference_function_name")).select(F.col("query_id").alias("neighbour"), F.col("reference_function_name").alias("anchor"))
    return rows.join(named, "neighbour", "left").select("case_id", "relation", F.lit(0).alias("pos"), "anchor", "neighbour")


def breakdown(policy: Policy, totals: DataFrame | None = None) -> Column:
    """the parts of a score, with the weights."""
    return F.struct("primary_matches", "auxiliary_matches", "missing_anchor_edges", "unknown_extra_neighbors", F.lit(policy.primary_bonus).alias("primary_edge_bonus"), F.lit(policy.auxiliary_bonus).alias("auxiliary_edge_bonus"), F.lit(policy.missing_penalty).alias("missing_anchor_penalty"))
