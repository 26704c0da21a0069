"""Registered queries: each group of operators on the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.checkpoints import tabled
from linkweave.functions import features as FF
from linkweave.functions.names import name_summary, role_hint
from linkweave.operators import analyst, decide, metrics, review, scoring, store
from linkweave.operators import anchors as A
from linkweave.operators import candidates as C
from linkweave.operators import extensions as X
from linkweave.plans import runs
from linkweave.plans.adapter import POLICY, Tables
from linkweave.policy import Policy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of the tables under its own name, which no other has."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def joined(x: str | Column, sep: str = ";") -> Column:
    return F.array_join(x, sep)


# The views of plans.adapter in SQL, and the steps of a run on them.
GRAPH = """
WITH lines AS (SELECT 'S' || l_suppkey AS src_name, 'P' || l_partkey AS dst_name, CASE l_linestatus WHEN 'O' THEN 'x86_64' ELSE 'aarch64' END AS architecture,
  CASE l_returnflag WHEN 'N' THEN 'O0' WHEN 'A' THEN 'O2' ELSE 'O3' END AS opt_level FROM lineitem),
edges AS (SELECT DISTINCT * FROM lines UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey, a, 'O0' FROM supplier, (VALUES ('x86_64'), ('aarch64')) t(a)),
pairs AS (SELECT architecture, src_name, dst_name, list(DISTINCT opt_level ORDER BY opt_level) AS opt_levels FROM edges GROUP BY ALL),
ref_functions AS (SELECT n AS function_name, CASE WHEN n IN (SELECT 'P' || p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part)) THEN 'reference_external' ELSE 'reference' END AS graph_role
  FROM (SELECT src_name AS n FROM edges UNION SELECT dst_name FROM edges)),
ref_names AS (SELECT DISTINCT function_name AS name FROM ref_functions WHERE graph_role = 'reference'),
bought AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
best AS (SELECT o_custkey, 'S' || l_suppkey AS expected_function FROM bought QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1),
cases AS (SELECT c_custkey AS case_id, c_mktsegment AS mode, c_nationkey AS query_file, 'C' || c_custkey AS query_func, CASE WHEN c_custkey % 2 = 0 THEN 'x86_64' ELSE 'aarch64' END AS architecture, expected_function
  FROM customer LEFT JOIN best ON c_custkey = o_custkey),
sums AS (SELECT o_custkey AS case_id, 'S' || l_suppkey AS name, sum(l_quantity) AS w FROM bought GROUP BY ALL),
ranked_sums AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY w DESC, name) AS rank, max(w) OVER (PARTITION BY case_id) AS m FROM sums),
listed AS (SELECT case_id, (rank - 1)::INT AS pos, name, round(6e-1 + 1e-1 * w / m, 6) AS prior, rank::INT AS rank FROM ranked_sums WHERE rank <= 5),
parts_of AS (SELECT DISTINCT o_custkey AS case_id, 'P' || l_partkey AS name FROM bought),
neighbours AS (SELECT case_id, 'callee' AS relation, (row_number() OVER (PARTITION BY case_id ORDER BY name) - 1)::INT AS pos, name FROM parts_of
  UNION ALL SELECT c_custkey, 'caller', 0, 'N' || c_nationkey FROM customer),
seeds AS (SELECT 'P' || p_partkey AS name FROM part WHERE p_size <= 10 UNION ALL SELECT 'N' || n_nationkey FROM nation),
anchors AS (SELECT case_id, relation, pos, name AS anchor FROM neighbours JOIN seeds USING (name))
"""
EXPANDED = (
    GRAPH
    + """,
support AS (
  SELECT DISTINCT a.case_id, 'candidate_calls_anchor' AS edge_relation, a.anchor, e.src_name AS name, e.opt_level FROM anchors a JOIN cases c USING (case_id) JOIN edges e ON e.architecture = c.architecture AND e.dst_name = a.anchor WHERE a.relation = 'callee'
  UNION SELECT DISTINCT a.case_id, 'anchor_calls_candidate', a.anchor, e.dst_name, e.opt_level FROM anchors a JOIN cases c USING (case_id) JOIN edges e ON e.architecture = c.architecture AND e.src_name = a.anchor WHERE a.relation = 'caller'),
expanded AS (SELECT case_id, name, count(*) FILTER (opt_level = 'O0') AS primary_support, count(*) FILTER (opt_level <> 'O0') AS auxiliary_support FROM support
  WHERE name IN (SELECT name FROM ref_names) AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.case_id = support.case_id AND l.name = support.name) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY primary_support DESC, auxiliary_support DESC, name DESC) AS place FROM expanded QUALIFY place <= 80),
candidates AS (SELECT case_id, pos, name, prior, rank, 'retrieval' AS candidate_source FROM listed
  UNION ALL SELECT p.case_id, (coalesce(b.last, -1) + place)::INT, p.name, 65e-2, (coalesce(b.names, 0) + place)::INT, 'callgraph_expansion'
  FROM placed p LEFT JOIN (SELECT case_id, count(DISTINCT name) AS names, max(pos) AS last FROM listed GROUP BY case_id) b USING (case_id))
"""
)
SCORED = (
    EXPANDED
    + """,
asked AS (SELECT k.case_id, k.pos, c.architecture, a.relation, a.pos AS place_at, CASE a.relation WHEN 'callee' THEN k.name ELSE a.anchor END AS src_name, CASE a.relation WHEN 'callee' THEN a.anchor ELSE k.name END AS dst_name
  FROM candidates k JOIN cases c USING (case_id) JOIN anchors a USING (case_id)),
matched AS (SELECT asked.*, opt_levels, coalesce(list_contains(opt_levels, 'O0'), false) AS p FROM asked LEFT JOIN pairs USING (architecture, src_name, dst_name)),
counted AS (SELECT case_id, pos, count(*) FILTER (p) AS primary_matches, count(*) FILTER (opt_levels IS NOT NULL AND NOT p) AS auxiliary_matches, count(*) FILTER (opt_levels IS NULL) AS missing_anchor_edges,
  list(CASE WHEN p THEN 'primary_' || relation || '_anchor_match:' || src_name || '->' || dst_name ELSE 'aux_' || relation || '_anchor_match:' || src_name || '->' || dst_name || ':' || array_to_string(opt_levels, ',') END ORDER BY relation, place_at)
    FILTER (opt_levels IS NOT NULL) AS evidence FROM matched GROUP BY case_id, pos),
raw AS (SELECT k.*, coalesce(primary_matches, 0) AS primary_matches, coalesce(auxiliary_matches, 0) AS auxiliary_matches, coalesce(missing_anchor_edges, 0) AS missing_anchor_edges, coalesce(evidence, []) AS evidence FROM candidates k LEFT JOIN counted USING (case_id, pos)),
scored AS (SELECT *, primary_matches * 4e-2 + auxiliary_matches * 15e-3 - missing_anchor_edges * 2e-3 AS g FROM raw),
ranked AS (SELECT * EXCLUDE (g), round(g, 6) AS graph_score, round(prior + g, 6) AS final_score, row_number() OVER (PARTITION BY case_id ORDER BY round(prior + g, 6) DESC, primary_matches DESC, prior DESC, name DESC, pos)::INT AS final_rank FROM scored)
"""
)
DECIDED = (
    SCORED
    + """,
wide AS (SELECT r.*, lead(final_score) OVER (PARTITION BY case_id ORDER BY final_rank) AS nxt, max(final_score) OVER (PARTITION BY case_id) AS top, expected_function FROM ranked r JOIN cases USING (case_id)),
summed AS (SELECT case_id, max(name) FILTER (final_rank = 1) AS predicted, max(final_score) FILTER (final_rank = 1) AS s1, max(nxt) FILTER (final_rank = 1) AS s2, max(primary_matches) FILTER (final_rank = 1) AS p1,
  count(*) FILTER (final_score = top) AS tied, list(name ORDER BY final_rank) FILTER (final_score = top) AS tied_names, min(final_rank) FILTER (name = expected_function) AS expected_final_rank, arg_min(name, pos) AS first_of_list,
  count(*) AS candidate_count, count(DISTINCT name) FILTER (candidate_source = 'retrieval') AS retrieval_candidate_count, count(*) FILTER (candidate_source <> 'retrieval') AS expanded_candidate_count,
  coalesce(bool_or(name = expected_function) FILTER (candidate_source = 'retrieval'), false) AS in_retrieval FROM wide GROUP BY case_id),
n_anchors AS (SELECT case_id, count(*) FILTER (relation = 'callee') AS callee_anchor_count, count(*) FILTER (relation = 'caller') AS caller_anchor_count FROM anchors GROUP BY case_id),
joined AS (SELECT c.*, s.* EXCLUDE (case_id), coalesce(callee_anchor_count, 0) AS callee_anchor_count, coalesce(caller_anchor_count, 0) AS caller_anchor_count FROM cases c LEFT JOIN summed s USING (case_id) LEFT JOIN n_anchors USING (case_id)),
decided AS (SELECT *, CASE WHEN predicted IS NULL THEN ['no_candidates'] ELSE list_filter([CASE WHEN callee_anchor_count + caller_anchor_count = 0 THEN 'no_anchor_evidence' END, CASE WHEN p1 < 1 THEN 'insufficient_primary_graph_matches' END,
  CASE WHEN s1 - coalesce(s2, 0e0) < 15e-3 THEN 'low_score_margin' END, CASE WHEN tied > 1 THEN 'multiple_candidates_same_final_score' END], lambda x: x IS NOT NULL) END AS reasons FROM joined),
stated AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'deferred' ELSE 'accepted' END AS status0 FROM decided),
results AS (SELECT * EXCLUDE (reasons), CASE WHEN clash THEN 'conflict' ELSE status0 END AS status, CASE WHEN clash THEN ['duplicate_accepted_mapping_in_query_scope'] ELSE reasons END AS reasons,
  CASE WHEN coalesce(expected_function, '') <> '' THEN coalesce(predicted = expected_function, false) END AS top1_hit FROM
  (SELECT *, status0 = 'accepted' AND count(*) FILTER (status0 = 'accepted') OVER (PARTITION BY query_file, predicted) > 1 AS clash FROM stated)),
flags AS (SELECT *, coalesce(first_of_list, '') AS retrieval_top1, coalesce(predicted, '') AS propagation_top1, coalesce(first_of_list, '') IS NOT DISTINCT FROM expected_function AS retrieval_top1_hit,
  coalesce(predicted, '') IS NOT DISTINCT FROM expected_function AS propagation_top1_hit, coalesce(expected_final_rank <= 3, false) AS propagation_top3_hit, coalesce(expected_final_rank <= 5, false) AS propagation_top5_hit,
  expected_final_rank IS NOT NULL AS expected_in_candidates, coalesce(in_retrieval, false) AS expected_in_retrieval_candidates, coalesce(first_of_list, '') <> coalesce(predicted, '') AS top1_changed FROM results)
"""
)
FEATURES = """
WITH lines AS (SELECT 'S' || l_suppkey AS src_name, 'P' || l_partkey AS dst_name, CASE l_linestatus WHEN 'O' THEN 'x86_64' ELSE 'aarch64' END AS architecture,
  CASE l_returnflag WHEN 'N' THEN 'O0' WHEN 'A' THEN 'O2' ELSE 'O3' END AS opt_level, l_suppkey FROM lineitem),
levels AS (SELECT a AS architecture, o AS opt_level FROM (VALUES ('x86_64'), ('aarch64')) x(a), (VALUES ('O0'), ('O2'), ('O3')) y(o)),
small AS (SELECT p_partkey, f FROM part, (VALUES (0), (1)) t(f) WHERE p_size <= 5 AND (p_size = 1 OR p_partkey % 2 = f)),
defined AS (SELECT DISTINCT src_name AS function_name, architecture, opt_level, l_suppkey % 2 AS f, l_suppkey AS r FROM lines
  UNION ALL SELECT 'P' || p_partkey, architecture, opt_level, f, p_partkey + 1000000 FROM small, levels),
called AS (SELECT DISTINCT l.src_name, l.dst_name, l.architecture, l.opt_level, l.l_suppkey % 2 AS f, l.l_suppkey AS r FROM lines l),
calls AS (SELECT c.*, d.function_name IS NOT NULL AS internal, CASE WHEN d.function_name IS NOT NULL THEN 'ref' ELSE 'external' END || '::Lua_547::' || c.architecture || '::' || c.opt_level || '::nostrip::' || c.dst_name AS dst_id,
  'ref::Lua_547::' || c.architecture || '::' || c.opt_level || '::nostrip::' || c.src_name AS src_id
  FROM called c LEFT JOIN defined d ON d.function_name = c.dst_name AND d.architecture = c.architecture AND d.opt_level = c.opt_level AND d.f = c.f)
"""


def _anchors(t: Tables) -> DataFrame:
    return A.anchored_neighbours(t.neighbours, t.cases, A.seed_anchors(t.mappings), store.reference_names(t.functions), POLICY)


def _expanded(t: Tables) -> DataFrame:
    return C.expanded_names(t.cases, tabled(_anchors(t)), t.pairs, store.reference_names(t.functions), C.retrieval_candidates(t.listed), POLICY)


def _combined(t: Tables) -> DataFrame:
    """Retrieved candidates and the best expanded ones, without multiplying hubs by the cases that they anchor."""
    rows = C.chosen(t.cases, tabled(_anchors(t)), t.pairs, store.reference_names(t.functions), C.retrieval_candidates(t.listed), POLICY)
    return rows.drop(*C.COUNTS)


def _top(t: Tables) -> DataFrame:
    """The best expanded candidates, without multiplying hubs by the cases that they anchor."""
    names, retrieved = store.reference_names(t.functions), C.retrieval_candidates(t.listed)
    return C.expanded_of(C.best(t.cases, tabled(_anchors(t)), t.pairs, names, retrieved, POLICY))


def _run(t: Tables) -> runs.Scored:
    return runs.propagate_from_anchors(t.cases, t.neighbours, A.seed_anchors(t.mappings), t.listed, t.functions, t.pairs, POLICY)


def _minimal(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    expected = t.cases.where("expected_function is not null").select(F.col("query_func").alias("query_id"), "expected_function")
    return runs.score_query_graph(t.retrieval, t.query_edges, t.mappings, t.pairs, expected, Policy.minimal())


SCORES = ("primary_matches", "auxiliary_matches", "missing_anchor_edges", "graph_score", "final_score")


# Store (B, C)


@query(FEATURES + """, vertices AS (
  SELECT 'ref::Lua_547::' || architecture || '::' || opt_level || '::nostrip::' || function_name AS function_id, function_name, 'reference' AS graph_role, architecture, opt_level, f, r FROM defined
  UNION ALL SELECT dst_id, dst_name, 'reference_external', architecture, opt_level, f, r FROM calls WHERE NOT internal)
SELECT function_id, function_name, graph_role, architecture, opt_level, 'Lua_547/' || architecture || '/' || opt_level || '/nostrip/part' || f || '.json' AS source_json
FROM vertices QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY f, r) = 1""")  # fmt: skip
def ref_functions_dedup(t: Tables) -> DataFrame:
    """B3, B6."""
    return store.functions(t.features).select("function_id", "function_name", "graph_role", "architecture", "opt_level", "source_json")


@query(FEATURES + """SELECT src_id, dst_id, src_name, dst_name, architecture, opt_level, 'Lua_547/' || architecture || '/' || opt_level || '/nostrip/part' || f || '.json' AS source_json
FROM calls QUALIFY row_number() OVER (PARTITION BY src_id, dst_id ORDER BY f, r, dst_name) = 1""")  # fmt: skip
def edge_resolution(t: Tables) -> DataFrame:
    """B4, B5, B7."""
    return store.edges(t.features).select("src_id", "dst_id", "src_name", "dst_name", "architecture", "opt_level", "source_json")


@query(FEATURES + """SELECT architecture, opt_level, functions, coalesce(edges, 0) AS edges, coalesce(external_calls, 0) AS external_calls
FROM (SELECT architecture, opt_level, count(*) AS functions FROM defined GROUP BY ALL) LEFT JOIN (SELECT architecture, opt_level, count(*) AS edges, count(*) FILTER (NOT internal) AS external_calls FROM calls GROUP BY ALL) USING (architecture, opt_level)""")  # fmt: skip
def store_env_counts(t: Tables) -> DataFrame:
    """B8."""
    return store.build_counts(t.features).select("architecture", "opt_level", "functions", "edges", "external_calls")


@query(GRAPH + "SELECT DISTINCT 'C' || o_custkey AS src, 'P' || l_partkey AS dst FROM bought UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer")
def query_adjacency(t: Tables) -> DataFrame:
    """B9."""
    return store.query_adjacency(t.query_edges)


@query(GRAPH + "SELECT architecture, src_name, dst_name, array_to_string(opt_levels, ',') AS opt_levels FROM pairs")
def pair_opt_levels(t: Tables) -> DataFrame:
    """C2."""
    return store.pair_levels(t.edges).select("architecture", "src_name", "dst_name", joined("opt_levels", ",").alias("opt_levels"))


@query(GRAPH + "SELECT dst_name, architecture, opt_level FROM edges WHERE src_name = 'S7'")
def callee_lookup(t: Tables) -> DataFrame:
    """C6."""
    return store.callees_of(t.edges, "S7").select("dst_name", "architecture", "opt_level")


@query(GRAPH + "SELECT src_name, architecture, opt_level FROM edges WHERE dst_name = 'P7'")
def caller_lookup(t: Tables) -> DataFrame:
    """C6."""
    return store.callers_of(t.edges, "P7").select("src_name", "architecture", "opt_level")


@query(GRAPH + "SELECT len(opt_levels)::INT AS levels, count(*) AS pairs FROM pairs GROUP BY ALL")
def edge_opt_observation(t: Tables) -> DataFrame:
    """At how many levels edges are seen."""
    return store.pair_levels(t.edges).groupBy(F.size("opt_levels").alias("levels")).agg(F.count("*").alias("pairs"))


@query(GRAPH + "SELECT name FROM ref_names")
def reference_names(t: Tables) -> DataFrame:
    """C1."""
    return store.reference_names(t.functions)


# Anchors and candidates (D, E, C)


@query(GRAPH + "SELECT 'P' || p_partkey AS query_id, 'P' || p_partkey AS reference_function_name FROM part WHERE p_size <= 10 UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation")
def anchor_names(t: Tables) -> DataFrame:
    """D1, D2."""
    return A.anchor_names(t.mappings)


@query(GRAPH + """SELECT case_id, relation, min(pos)::INT AS pos, name AS anchor FROM neighbours WHERE name IN (SELECT name FROM ref_names) AND NOT starts_with(name, 'P1') GROUP BY ALL""")
def visible_anchors(t: Tables) -> DataFrame:
    """D3, D4, with an excluded prefix."""
    names = store.reference_names(t.functions)
    return A.visible_neighbours(t.neighbours, t.cases, names, Policy.hybrid(exclude_prefixes=("P1",))).select("case_id", "relation", "pos", "anchor")


@query(GRAPH + "SELECT case_id, relation, pos, anchor, 'seed_anchor' AS source FROM anchors")
def seeded_anchors(t: Tables) -> DataFrame:
    """D5, seeds only."""
    return _anchors(t).select("case_id", "relation", "pos", "anchor", "source")


@query(GRAPH + """SELECT n.case_id, n.relation, n.pos, n.name AS anchor, CASE WHEN s.name IS NOT NULL THEN 'seed_anchor' ELSE 'visible_reference_name_anchor' END AS source
FROM neighbours n LEFT JOIN seeds s USING (name) WHERE s.name IS NOT NULL OR (n.name IN (SELECT name FROM ref_names) AND NOT starts_with(n.name, 'P1'))""")
def mixed_anchors(t: Tables) -> DataFrame:
    """D5, with visible names."""
    policy = Policy(allow_visible_names=True, exclude_prefixes=("P1",))
    return A.anchored_neighbours(t.neighbours, t.cases, A.seed_anchors(t.mappings), store.reference_names(t.functions), policy).select("case_id", "relation", "pos", "anchor", "source")


@query(GRAPH + "SELECT case_id, pos, name, prior, rank, 'retrieval' AS candidate_source FROM listed")
def retrieval_rank(t: Tables) -> DataFrame:
    """E1."""
    return C.retrieval_candidates(t.listed)


@query(GRAPH + "SELECT query_func AS query_id, name AS retrieval_top1 FROM listed JOIN cases USING (case_id) WHERE rank = 1")
def retrieval_top1(t: Tables) -> DataFrame:
    """E2."""
    return C.retrieval_top1(t.retrieval)


@query(EXPANDED + "SELECT case_id, coalesce(n, '') AS retrieval_top1 FROM cases LEFT JOIN (SELECT case_id, arg_min(name, pos) AS n FROM candidates GROUP BY case_id) USING (case_id)")
def first_of_list(t: Tables) -> DataFrame:
    """E3."""
    return C.first_of_list(t.cases, _combined(t))


@query(EXPANDED + "SELECT case_id, name, primary_support, auxiliary_support FROM expanded")
def expand_candidates(t: Tables) -> DataFrame:
    """C3."""
    return _expanded(t).select("case_id", "name", "primary_support", "auxiliary_support")


@query(EXPANDED + "SELECT case_id, name, primary_support, auxiliary_support, place::INT AS place FROM placed")
def expand_topk(t: Tables) -> DataFrame:
    """C4."""
    return _top(t).select("case_id", "name", "primary_support", "auxiliary_support", "place")


@query(EXPANDED + "SELECT case_id, pos, name, prior, rank, candidate_source FROM candidates")
def candidates_combined(t: Tables) -> DataFrame:
    """C5."""
    return _combined(t)


# Scores, ranks, decisions (F, G)


@query(SCORED + "SELECT case_id, pos, name, prior, primary_matches, auxiliary_matches, missing_anchor_edges, graph_score, final_score FROM ranked")
def score_candidates(t: Tables) -> DataFrame:
    """F2, F3."""
    return _run(t).scores.select("case_id", "pos", "name", "prior", *SCORES)


@query(GRAPH + """, links AS (SELECT n.case_id, n.relation, n.name AS neighbour, s.name AS anchor FROM neighbours n LEFT JOIN seeds s USING (name)),
asked AS (SELECT k.case_id, k.pos, c.architecture, l.relation, l.neighbour, l.anchor, CASE l.relation WHEN 'callee' THEN k.name ELSE l.anchor END AS src_name, CASE l.relation WHEN 'callee' THEN l.anchor ELSE k.name END AS dst_name
  FROM listed k JOIN cases c USING (case_id) JOIN links l USING (case_id)),
matched AS (SELECT asked.*, opt_levels, coalesce(list_contains(opt_levels, 'O0'), false) AS p FROM asked LEFT JOIN pairs USING (architecture, src_name, dst_name)),
counted AS (SELECT case_id, pos, count(*) FILTER (p) AS primary_matches, count(*) FILTER (opt_levels IS NOT NULL AND NOT p) AS auxiliary_matches, count(*) FILTER (anchor IS NOT NULL AND opt_levels IS NULL) AS missing_anchor_edges,
  count(*) FILTER (anchor IS NULL) AS unknown_extra_neighbors FROM matched GROUP BY ALL),
raw AS (SELECT k.*, n.* EXCLUDE (case_id, pos), primary_matches * 4e-2 + auxiliary_matches * 15e-3 - missing_anchor_edges * 2e-3 AS g FROM listed k JOIN counted n USING (case_id, pos))
SELECT query_func AS case_id, name, primary_matches, auxiliary_matches, missing_anchor_edges, unknown_extra_neighbors, unknown_extra_neighbors > 0 AS custom_suspected, round(g, 6) AS graph_score, round(prior + g, 6) AS final_score,
  row_number() OVER (PARTITION BY raw.case_id ORDER BY round(prior + g, 6) DESC, primary_matches DESC, prior DESC, pos)::INT AS final_rank FROM raw JOIN cases USING (case_id)""")  # fmt: skip
def score_unanchored(t: Tables) -> DataFrame:
    """F1, F6, G1 with ties to the earlier candidate."""
    return _minimal(t)[0].select("case_id", "name", *SCORES, "unknown_extra_neighbors", "custom_suspected", "final_rank")


@query(SCORED + "SELECT case_id, pos, array_to_string(evidence[1:30], ';') AS evidence FROM ranked")
def evidence_strings(t: Tables) -> DataFrame:
    """F4, F5."""
    return _run(t).ranked.select("case_id", "pos", joined("evidence").alias("evidence"))


@query(SCORED + "SELECT case_id, pos, primary_matches, auxiliary_matches, missing_anchor_edges, 0::BIGINT AS unknown_extra_neighbors, 4e-2 AS primary_edge_bonus, 15e-3 AS auxiliary_edge_bonus, 2e-3 AS missing_anchor_penalty FROM ranked")
def graph_breakdown(t: Tables) -> DataFrame:
    """F7."""
    return _run(t).scores.select("case_id", "pos", scoring.breakdown(POLICY).alias("b")).select("case_id", "pos", "b.*")


@query(SCORED + "SELECT case_id, name, final_score, final_rank FROM ranked")
def rerank(t: Tables) -> DataFrame:
    """G1 with ties to the larger name."""
    return _run(t).scores.select("case_id", "name", "final_score", "final_rank")


@query(DECIDED + "SELECT case_id, predicted AS predicted_function_name, status0 AS status, array_to_string(reasons, ';') AS status_reasons FROM stated")
def classify(t: Tables) -> DataFrame:
    """G2."""
    done = _run(t)
    return decide.case_results(t.cases, done.scores, done.anchors, POLICY).select("case_id", "predicted_function_name", "status", joined("status_reasons").alias("status_reasons"))


@query(DECIDED + "SELECT case_id, coalesce(array_to_string(tied_names[1:20], ';'), '') AS top_tied_candidates FROM decided")
def tied_top(t: Tables) -> DataFrame:
    """G3."""
    return _run(t).results.select("case_id", joined("top_tied_candidates").alias("top_tied_candidates"))


@query(DECIDED + "SELECT case_id, query_file, predicted AS predicted_function_name, status, array_to_string(reasons, ';') AS status_reasons FROM results")
def conflicts(t: Tables) -> DataFrame:
    """G4."""
    return _run(t).results.select("case_id", "query_file", "predicted_function_name", "status", joined("status_reasons").alias("status_reasons"))


@query(DECIDED + "SELECT case_id, expected_function, expected_final_rank FROM decided")
def expected_rank(t: Tables) -> DataFrame:
    """G5."""
    return _run(t).results.select("case_id", "expected_function", "expected_final_rank")


@query(SCORED + "SELECT case_id, final_rank, name, final_score FROM ranked WHERE final_rank <= 5")
def top_n(t: Tables) -> DataFrame:
    """G6."""
    return decide.top(_run(t).scores, POLICY.output_top_candidates).select("case_id", "final_rank", "name", "final_score")


@query(DECIDED + """SELECT case_id, retrieval_top1, propagation_top1, retrieval_top1_hit, propagation_top1_hit, propagation_top3_hit, propagation_top5_hit, expected_in_candidates, expected_in_retrieval_candidates, top1_changed,
  coalesce(candidate_count, 0) AS candidate_count, coalesce(retrieval_candidate_count, 0) AS retrieval_candidate_count, coalesce(expanded_candidate_count, 0) AS expanded_candidate_count, callee_anchor_count, caller_anchor_count FROM flags""")
def case_flags(t: Tables) -> DataFrame:
    """G7."""
    flags = ("retrieval_top1", "propagation_top1", "retrieval_top1_hit", "propagation_top1_hit", "propagation_top3_hit", "propagation_top5_hit", "expected_in_candidates", "expected_in_retrieval_candidates", "top1_changed")
    return _run(t).results.select("case_id", *flags, "candidate_count", "retrieval_candidate_count", "expanded_candidate_count", "callee_anchor_count", "caller_anchor_count")


# Metrics (H)


@query(DECIDED + """SELECT count(*) AS expected_count, round(count(*) FILTER (retrieval_top1 = expected_function) / count(*), 6) AS retrieval_top1_accuracy, round(count(*) FILTER (propagation_top1 = expected_function) / count(*), 6) AS graph_top1_accuracy,
  count(*) FILTER (retrieval_top1 <> expected_function AND propagation_top1 = expected_function) AS improved, count(*) FILTER (retrieval_top1 = expected_function AND propagation_top1 <> expected_function) AS regressed FROM flags WHERE expected_function <> ''""")
def metrics_top1(t: Tables) -> DataFrame:
    """H1."""
    return metrics.top1_metrics(_run(t).results)


HYBRID_METRICS = """count(*) AS case_count, round(avg(retrieval_top1_hit::INT), 6) AS retrieval_top1_accuracy, round(avg(propagation_top1_hit::INT), 6) AS propagation_top1_accuracy, round(avg(propagation_top3_hit::INT), 6) AS propagation_top3_accuracy,
  round(avg(propagation_top5_hit::INT), 6) AS propagation_top5_accuracy, round(avg(expected_in_retrieval_candidates::INT), 6) AS candidate_recall_before_expansion, round(avg(expected_in_candidates::INT), 6) AS candidate_recall_after_expansion,
  count(*) FILTER (NOT retrieval_top1_hit AND propagation_top1_hit) AS improved, count(*) FILTER (retrieval_top1_hit AND NOT propagation_top1_hit) AS regressed FROM flags"""


@query(DECIDED + "SELECT " + HYBRID_METRICS)
def metrics_summary(t: Tables) -> DataFrame:
    """H2."""
    return metrics.summary(_run(t).results)


@query(DECIDED + "SELECT coalesce(nullif(mode, ''), 'unknown') AS mode, " + HYBRID_METRICS + " GROUP BY 1")
def metrics_by_mode(t: Tables) -> DataFrame:
    """H3."""
    return metrics.summary_by_mode(_run(t).results)


@query(DECIDED + """SELECT count(*) AS case_count, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (status = 'conflict') AS conflict,
  round(count(*) FILTER (top1_hit) / count(*) FILTER (expected_function <> ''), 6) AS top1_accuracy, round(count(*) FILTER (expected_final_rank <= 5 AND expected_function <> '') / count(*) FILTER (expected_function <> ''), 6) AS top5_accuracy,
  round(count(*) FILTER (top1_hit AND status = 'accepted') / count(*) FILTER (expected_function <> '' AND status = 'accepted'), 6) AS accepted_accuracy FROM results""")
def status_summary(t: Tables) -> DataFrame:
    """H4, X10."""
    return metrics.status_summary(_run(t).results)


CATEGORY = """CASE WHEN list_has_any(reasons, ['multiple_candidates_same_final_score', 'low_score_margin']) THEN 'ambiguous_candidate_tie' WHEN list_contains(reasons, 'no_anchor_evidence') THEN 'needs_more_graph_anchors'
  WHEN list_contains(reasons, 'duplicate_accepted_mapping_in_query_scope') THEN 'mapping_conflict' ELSE 'manual_review' END"""


@query(DECIDED + f"SELECT {CATEGORY} AS review_category, count(*) AS cases FROM results WHERE status <> 'accepted' GROUP BY 1")
def review_categories(t: Tables) -> DataFrame:
    """H5, I8, P9."""
    return review.category_counts(_run(t).results)


# Review records (I) and prompts (K)

NAMES = {"luaL_": "ECONOMY", "lua_": "SMALL", "luaV_": "MEDIUM", "luaD_": "LARGE", "luaU_": "PROMO", "luaX_": "STANDARD"}
PREFIXED = "CASE " + " ".join(f"WHEN starts_with(p_type, '{b}') THEN '{a}' || p_name" for a, b in NAMES.items()) + " WHEN p_size = 3 THEN '' WHEN p_size = 4 THEN 'llex' ELSE p_name END"


def _prefixed() -> Column:
    rule = None
    for prefix, kind in NAMES.items():
        value, asked = F.concat(F.lit(prefix), "p_name"), F.col("p_type").startswith(kind)
        rule = F.when(asked, value) if rule is None else rule.when(asked, value)
    return rule.when(F.col("p_size") == 3, "").when(F.col("p_size") == 4, "llex").otherwise(F.col("p_name"))


@query(f"""WITH n AS (SELECT p_partkey, {PREFIXED} AS name FROM part)
SELECT p_partkey, name, CASE WHEN coalesce(name, '') = '' THEN 'unknown' WHEN starts_with(name, 'luaL_') THEN 'Lua auxiliary library API/helper' WHEN starts_with(name, 'lua_') THEN 'Lua public C API' WHEN starts_with(name, 'luaV_') THEN 'Lua VM execution/runtime'
  WHEN starts_with(name, 'luaD_') THEN 'Lua call/stack/error runtime' WHEN starts_with(name, 'luaU_') THEN 'Lua binary chunk undump/load support' WHEN starts_with(name, 'luaX_') OR name = 'llex' THEN 'Lua lexer/parser front-end'
  WHEN starts_with(name, 'luaC_') THEN 'Lua garbage collector' ELSE 'Lua internal/static helper or custom candidate' END AS role FROM n""")
def role_hints(t: Tables) -> DataFrame:
    """I6."""
    return t.read("part").select("p_partkey", _prefixed().alias("name")).select("p_partkey", "name", role_hint("name")["role"].alias("role"))


@query("""WITH w AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda x: CASE WHEN length(x) % 3 = 0 THEN 'FUN_' || x ELSE x END) AS names FROM documents),
v AS (SELECT *, list_filter(names, lambda x: x <> '' AND NOT starts_with(x, 'FUNC_') AND NOT starts_with(x, 'FUN_') AND NOT starts_with(x, 'sub_')) AS visible FROM w)
SELECT doc_id, len(names)::INT AS total_count, len(visible)::INT AS visible_count, (len(names) - len(visible))::INT AS anonymous_count, array_to_string(visible[1:12], ';') AS visible_names FROM v""")
def name_visibility(t: Tables) -> DataFrame:
    """I2."""
    names = F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda x: F.when(F.length(x) % 3 == 0, F.concat(F.lit("FUN_"), x)).otherwise(x))
    s = t.read("documents").select("doc_id", names.alias("names")).select("doc_id", name_summary("names").alias("s"))
    return s.select("doc_id", "s.total_count", "s.visible_count", "s.anonymous_count", joined("s.visible_names").alias("visible_names"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS strings, n_chars % 1000 AS n, n_chars % 50 AS b, string_split(coalesce(text, ''), ' ') AS callees FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN len(strings) > 0 THEN 'string_rich' END, CASE WHEN len(list_filter(strings, lambda x: contains(x, 'chunk') OR contains(x, 'lua_integer') OR contains(x, 'lua_number'))) > 0 THEN 'binary_chunk_or_loader_related_strings' END,
  CASE WHEN n >= 500 OR b >= 40 THEN 'large_complex_function' END, CASE WHEN n <= 120 AND b <= 5 THEN 'small_api_wrapper_like_function' END, CASE WHEN len(callees) >= 8 THEN 'call_heavy' END, CASE WHEN len(strings) = 0 THEN 'no_strings' END,
  CASE WHEN len(list_filter(strings, lambda x: NOT starts_with(x, 'FUNC_') AND NOT starts_with(x, 'FUN_') AND NOT starts_with(x, 'sub_'))) <= 1 THEN 'few_visible_callers' END], lambda x: x IS NOT NULL), ';') AS tags FROM w""")
def feature_tags(t: Tables) -> DataFrame:
    """I4: lines as strings and callers, words as callees, sizes from n_chars; texts are read whole."""
    text = F.coalesce("text", F.lit(""))
    rows = t.read("documents").select("doc_id", F.filter(F.split(text, "\n", -1), lambda x: x != "").alias("strings"), (F.col("n_chars") % 1000).cast("int").alias("n"), (F.col("n_chars") % 50).cast("int").alias("b"), F.split(text, " ", -1).alias("callees"))
    return rows.select("doc_id", joined(FF.feature_tags("strings", "callees", "strings", "n", "b")).alias("tags"))


@query("""WITH h AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k FROM h)
SELECT user_id, string_agg(event_type || ':' || c, ';' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY user_id""")
def top_items(t: Tables) -> DataFrame:
    """A histogram map in order of names, so ties keep that order."""
    counts = t.read("events").groupBy("user_id", "event_type").agg(F.count("*").cast("int").alias("c"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "c")))).alias("m"))
    return maps.select("user_id", joined(F.transform(FF.top_items("m", 3), lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string")))).alias("top"))


@query("""WITH v AS (SELECT l_orderkey, l_returnflag AS f, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey)[1:8] AS v FROM lineitem GROUP BY ALL),
o AS (SELECT l_orderkey, count(*)::INT AS offset_count, flatten(list(list_transform(v, lambda x: f || '=' || x) ORDER BY f))[1:8] AS s FROM v GROUP BY l_orderkey)
SELECT l_orderkey, offset_count, array_to_string(s, ';') AS sample FROM o""")
def compare_sample(t: Tables) -> DataFrame:
    """Parts of an order by return flag."""
    values = t.read("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("v"))
    maps = values.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", "v")))).alias("m")).select("l_orderkey", FF.compare_sample("m").alias("s"))
    return maps.select("l_orderkey", "s.offset_count", joined(F.transform("s.sample", lambda x: F.concat(x["offset"], F.lit("="), x["value"]))).alias("sample"))


@query(DECIDED + "SELECT case_id, round(s1 - s2, 6) AS score_margin_top1_top2 FROM results WHERE status <> 'accepted'")
def margin_delta(t: Tables) -> DataFrame:
    """I7."""
    done = _run(t).kept(POLICY.output_top_candidates)
    top = review.compact_candidates(done.top(POLICY.output_top_candidates), POLICY.output_top_candidates)
    return review.to_review(done.results).join(top, "case_id", "left").select("case_id", review.margin("top_candidates").alias("score_margin_top1_top2"))


def _features(t: Tables) -> DataFrame:
    """Feature rows of customers; every eleventh has none."""
    c, i = t.cases.where("case_id % 11 <> 0"), F.col("case_id")
    counts = F.array(*[F.struct(F.lit(f"OP{k:02}").alias("key"), ((i * 7 + k * k) % 13).cast("int").alias("value")) for k in range(12)])
    many = lambda n: F.sequence(F.lit(1), F.greatest(F.lit(1), (i % n).cast("int")))
    named = lambda letter, n: F.when(i % n == 0, F.array().cast("array<string>")).otherwise(F.transform(many(n), lambda k: F.concat(F.when(k % 3 == 0, "FUN_").otherwise(letter), k.cast("string"))))
    compare = F.create_map(F.lit("8"), F.transform(many(10), lambda k: k.cast("string")), F.lit("16"), F.array(F.lit("x"), "mode"))
    return c.select("query_file", "query_func", F.col("query_func").alias("function_name"), "architecture", "lua_version", (i % 60).cast("int").alias("basic_block_count"), (i % 900).cast("int").alias("pcode_instruction_count"),
        F.map_from_entries(counts).alias("pcode_opcode_histogram"), named("s", 25).alias("strings"), named("c", 14).alias("callees"), F.array(F.concat(F.lit("N"), F.col("query_file").cast("string"))).alias("callers"),
        F.transform(many(30), lambda k: k * 8).alias("struct_offsets"), compare.alias("compare"))


def millionths(x: str | Column) -> Column:
    """Scores as whole numbers: two engines write doubles differently."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 1_000_000).cast("long")


def _summary_text(s: Column) -> Column:
    """A feature summary in one line."""
    names = lambda x: F.concat_ws("/", x["total_count"], x["visible_count"], x["anonymous_count"], joined(x["visible_names"], ","))
    return F.concat_ws("|", s["function_name_debug_label"], s["architecture"], s["lua_version"], s["basic_block_count"], s["pcode_instruction_count"], joined(F.transform(s["top_pcode_opcodes"], lambda x: F.concat_ws(":", x["name"], x["count"])), ","),
        joined(s["strings"], ","), s["string_count"], names(s["callees"]), names(s["callers"]), joined(s["struct_offsets"].cast("array<string>"), ","), s["struct_offset_count"],
        s["compare_constants"]["offset_count"], joined(F.transform(s["compare_constants"]["sample"], lambda x: F.concat_ws("=", x["offset"], x["value"])), ","), joined(s["feature_tags"], ","))


def _candidates_text(c: Column) -> Column:
    """Compact candidates in one line."""
    one = lambda x: F.concat_ws("|", x["rank"], x["function_name"], x["role_hint"]["role"], x["role_hint"]["rationale"], x["source"], millionths(x["retrieval_prior"]), millionths(x["graph_score"]), millionths(x["final_score"]),
        x["primary_matches"], x["auxiliary_matches"], x["missing_anchor_edges"], joined(x["evidence"], ","))
    return F.coalesce(joined(F.transform(c, one)), F.lit(""))


# The same in SQL: feature rows, their summaries (with `opcodes` and `texts` of them) and all that a review record holds.
REVIEW = (
    DECIDED
    + """,
raw_features AS (SELECT case_id, query_file, query_func, architecture, (case_id % 60)::INT AS bb, (case_id % 900)::INT AS pc,
    list_transform(range(12), lambda k: {'k': k, 'n': 'OP' || lpad(k::VARCHAR, 2, '0'), 'c': ((case_id * 7 + k * k) % 13)::INT}) AS ops,
    CASE WHEN case_id % 25 = 0 THEN [] ELSE list_transform(range(1, greatest(1, case_id % 25) + 1), lambda k: CASE WHEN k % 3 = 0 THEN 'FUN_' ELSE 's' END || k) END AS strings,
    CASE WHEN case_id % 14 = 0 THEN [] ELSE list_transform(range(1, greatest(1, case_id % 14) + 1), lambda k: CASE WHEN k % 3 = 0 THEN 'FUN_' ELSE 'c' END || k) END AS callees,
    list_transform(range(1, greatest(1, case_id % 30) + 1), lambda k: (k * 8)::VARCHAR) AS offsets,
    list_transform(range(1, greatest(1, case_id % 10) + 1), lambda k: '8=' || k) || ['16=x', '16=' || mode] AS pairs_
  FROM cases WHERE case_id % 11 <> 0),
best_ops AS (SELECT case_id, list(o.n || ':' || o.c ORDER BY o.c DESC, o.k) AS named FROM (SELECT case_id, unnest(ops) AS o FROM raw_features) GROUP BY case_id),
shown AS (SELECT *, list_filter(callees, lambda x: NOT starts_with(x, 'FUN_')) AS visible FROM raw_features JOIN best_ops USING (case_id)),
tagged AS (SELECT *, array_to_string(list_filter([CASE WHEN len(strings) > 0 THEN 'string_rich' END, CASE WHEN pc >= 500 OR bb >= 40 THEN 'large_complex_function' END, CASE WHEN pc <= 120 AND bb <= 5 THEN 'small_api_wrapper_like_function' END,
  CASE WHEN len(callees) >= 8 THEN 'call_heavy' END, CASE WHEN len(strings) = 0 THEN 'no_strings' END, 'few_visible_callers'], lambda x: x IS NOT NULL), ',') AS tags FROM shown),
summaries AS (SELECT case_id, list_transform([[10, 20], [8, 12]], lambda m: concat_ws('|', query_func, architecture, 'Lua_547', bb, pc, array_to_string(named[1:m[1]], ','), array_to_string(strings[1:m[2]], ','), len(strings),
  concat_ws('/', len(callees), len(visible), len(callees) - len(visible), array_to_string(visible[1:12], ',')), '1/1/0/N' || query_file, array_to_string(offsets[1:20], ','), len(offsets), 2, array_to_string((list_filter(pairs_, lambda x: starts_with(x, '8='))[1:8] || list_filter(pairs_, lambda x: starts_with(x, '16=')))[1:8], ','), tags)) AS texts FROM tagged),
best_five AS (SELECT case_id, string_agg(concat_ws('|', final_rank, name, 'Lua internal/static helper or custom candidate', 'no public Lua API prefix', candidate_source, round(prior * 1000000)::BIGINT, round(graph_score * 1000000)::BIGINT, round(final_score * 1000000)::BIGINT,
  primary_matches, auxiliary_matches, missing_anchor_edges, array_to_string(evidence[1:5], ',')), ';' ORDER BY final_rank) AS top FROM ranked WHERE final_rank <= 5 GROUP BY case_id),
sides AS (SELECT case_id, array_to_string((list(anchor || '=' || anchor || '=seed_anchor' ORDER BY pos) FILTER (relation = 'callee'))[1:30], ';') AS callees, array_to_string((list(anchor || '=' || anchor || '=seed_anchor' ORDER BY pos) FILTER (relation = 'caller'))[1:30], ';') AS callers FROM anchors GROUP BY case_id),
reviewed AS (SELECT r.*, coalesce(top, '') AS top, coalesce(s.callees, '') AS callees, coalesce(s.callers, '') AS callers, texts, array_to_string(tied_names[1:20], ';') AS tied_text,
  CASE WHEN s2 IS NOT NULL THEN round(round(s1 - s2, 6) * 1000000)::BIGINT END AS margin, """
    + CATEGORY
    + """ AS category
  FROM results r LEFT JOIN best_five USING (case_id) LEFT JOIN sides s USING (case_id) LEFT JOIN summaries USING (case_id) WHERE status <> 'accepted')
"""
)
ACTION = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in review.ACTIONS.items()) + " END"
DESCRIBED = "array_to_string(list_transform(reasons, lambda x: x || '=' || CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in review.REASONS.items()) + " END), ';')"


def _records(t: Tables) -> DataFrame:
    return runs.review_run(_run(t), _features(t), POLICY)[0]


@query(REVIEW + """SELECT case_id, query_file, query_func, architecture, expected_function, predicted AS current_top_prediction, expected_final_rank, status, category AS review_category, margin AS score_margin, coalesce(tied_text, '') AS tied, callee_anchor_count, caller_anchor_count,
  coalesce(candidate_count, 0) AS total, coalesce(retrieval_candidate_count, 0) AS retrieval, coalesce(expanded_candidate_count, 0) AS expanded FROM reviewed""")  # fmt: skip
def review_records(t: Tables) -> DataFrame:
    """What a record takes over from the decision."""
    return _records(t).select("case_id", "query_file", "query_func", "architecture", "expected_function", "current_top_prediction", "expected_final_rank", "status", "review_category", millionths("score_margin_top1_top2").alias("score_margin"),
        joined("top_tied_candidates").alias("tied"), F.col("anchor_counts.callee").alias("callee_anchor_count"), F.col("anchor_counts.caller").alias("caller_anchor_count"), "candidate_counts.total", "candidate_counts.retrieval", "candidate_counts.expanded")


@query(REVIEW + f"SELECT case_id, {DESCRIBED} AS reasons, {ACTION} AS recommended_action FROM reviewed")
def review_advice(t: Tables) -> DataFrame:
    """I9, J14."""
    return _records(t).select("case_id", joined(F.transform("status_reasons", lambda x: F.concat_ws("=", x["reason"], x["description"]))).alias("reasons"), "recommended_action")


@query(REVIEW + "SELECT case_id, top FROM reviewed")
def review_candidates(t: Tables) -> DataFrame:
    """I10, in the record; the payload's are the same."""
    return _records(t).where("top_candidates IS NOT DISTINCT FROM llm_payload.candidate_summaries").select("case_id", _candidates_text(F.col("top_candidates")).alias("top"))


@query(REVIEW + "SELECT case_id, callees, callers FROM reviewed")
def review_anchors(t: Tables) -> DataFrame:
    """Anchors with the neighbour's own name and the source of its mapping."""
    text = lambda c: joined(F.transform(c, lambda x: F.concat_ws("=", x["query_neighbor_name"], x["reference_function_name"], x["source"])))
    return _records(t).select("case_id", text("anchors.callees").alias("callees"), text("anchors.callers").alias("callers"))


@query(REVIEW + "SELECT case_id, coalesce(texts[1], '') AS summary, texts IS NOT NULL AS attached FROM reviewed")
def review_features(t: Tables) -> DataFrame:
    """The feature summary of each record, where there is a feature row."""
    s = F.col("query_feature_summary")
    return _records(t).select("case_id", F.when(s.isNotNull(), _summary_text(s)).otherwise("").alias("summary"), s.isNotNull().alias("attached"))


PAYLOAD = "case_id, query_func, array_to_string(reasons, ';') AS reasons, top, concat_ws('/', callee_anchor_count, caller_anchor_count, tied_text) AS anchors"


def _payload_columns(p: Column, summary: Column) -> list[Column]:
    g = p["graph_anchor_summary"]
    return [p["query_function"].alias("query_func"), joined(p["deferred_reasons"]).alias("reasons"), _candidates_text(p["candidate_summaries"]).alias("top"),
        F.concat_ws("/", g["callee_anchor_count"], g["caller_anchor_count"], F.when(F.size(g["top_tied_candidates"]) > 0, joined(g["top_tied_candidates"]))).alias("anchors"), summary.alias("summary")]


@query(REVIEW + f"SELECT {PAYLOAD}, coalesce(texts[1], '') AS summary, '0.2' AS version, '{review.CLASSES}' AS classes FROM reviewed")
def review_payload(t: Tables) -> DataFrame:
    """The payload for a language model."""
    p = F.col("llm_payload")
    s = p["query_feature_summary"]
    return _records(t).select("case_id", *_payload_columns(p, F.when(s.isNotNull(), _summary_text(s)).otherwise("")), p["schema_version"].alias("version"), p["answer_format"]["classification"].alias("classes"))


@query(REVIEW + f"SELECT {PAYLOAD}, coalesce(texts[2], '') AS summary, category AS review_category, {ACTION} AS advised, margin AS score_margin, coalesce(tied_text, '') AS tied, 'prompt_exported' AS status, 'dry-run' AS provider FROM reviewed")
def prompt_dry_run(t: Tables) -> DataFrame:
    """K1 to K3, K6: the case as it stands in each prompt, read back from the prompt's JSON."""
    records = _records(t)
    payload = records.select("llm_payload").schema["llm_payload"].dataType.simpleString()
    case = f"struct<case_id:bigint,review_category:string,recommended_action_from_rules:string,score_margin_top1_top2:double,top_tied_candidates:array<string>,llm_payload:{payload}>"
    rows = analyst.dry_run(analyst.ordered(analyst.prompts(records)))
    c = F.from_json(F.regexp_extract("prompt", r"(?s)\nCase:\n(.*)", 1), case)
    s = c["llm_payload"]["query_feature_summary"]
    return rows.select(c["case_id"].alias("case_id"), *_payload_columns(c["llm_payload"], F.when(s["function_name_debug_label"].isNotNull(), _summary_text(s)).otherwise("")), c["review_category"].alias("review_category"),
        c["recommended_action_from_rules"].alias("advised"), millionths(c["score_margin_top1_top2"]).alias("score_margin"), joined(c["top_tied_candidates"]).alias("tied"), "status", "provider")


@query(REVIEW + """SELECT case_id, CASE WHEN case_id % 5 = 4 THEN 'error' ELSE 'completed' END AS status, CASE WHEN case_id % 5 = 4 THEN 'RuntimeError: no ' || case_id END AS error, CASE WHEN case_id % 5 IN (0, 1) THEN case_id END AS answered,
  case_id % 5 = 4 AS has_prompt, 'stub' AS provider, 'm' AS model FROM reviewed""")  # fmt: skip
def analyst_answers(t: Tables) -> DataFrame:
    """K5: one call for each prompt; failed ones are rows with the prompt, and K4 reads the others."""
    rows = analyst.ask(analyst.prompts(_records(t)), _stub_client, "stub", "m")
    return rows.select("case_id", "status", F.when(F.col("error").isNotNull(), F.concat(F.lit("RuntimeError: "), "error")).alias("error"), F.get_json_object("analysis", "$.case").cast("long").alias("answered"), F.col("prompt").isNotNull().alias("has_prompt"), "provider", "model")


def _stub_client(prompt: str) -> str:
    """Answers by the case's number: JSON alone, JSON in words, words alone, broken JSON, and no answer."""
    case = int(re.search(r'"case_id" : (\d+)', prompt)[1])
    if case % 5 == 4:
        raise RuntimeError(f"no {case}")
    return (f'{{"case": {case}}}', f'It is {{"case": {case}}}, surely.', "none", f'{{"case": {case}')[case % 5]


@query(REVIEW + "SELECT count(*) FILTER (status = 'deferred') AS deferred_cases, count(*) FILTER (status = 'conflict') AS conflict_cases, count(texts) AS features_attached FROM reviewed")
def review_counts(t: Tables) -> DataFrame:
    """H6."""
    return runs.review_run(_run(t), _features(t), POLICY)[1]


@query("SELECT event_id, props AS props, CASE WHEN event_id % 3 = 2 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def parse_answer(t: Tables) -> DataFrame:
    """K4: JSON alone, with text around it, and cut off."""
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("\n "), "props")).when(kind == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done."))).otherwise(F.concat(F.lit("none "), F.regexp_replace("props", r"\}", "")))
    rows = t.read("events").select("event_id", "props", text.alias("answer"))
    return rows.select("event_id", "props", F.get_json_object(analyst.parsed("answer"), "$.k").cast("long").alias("k"))


@query(REVIEW + "SELECT count(*) FILTER (case_id % 5 <> 4) AS completed, 0::BIGINT AS exported, count(*) FILTER (case_id % 5 = 4) AS errors FROM reviewed")
def analyst_summary(t: Tables) -> DataFrame:
    """H7."""
    return analyst.run_summary(analyst.ask(analyst.prompts(_records(t)), _stub_client, "stub", "m"))


# Extensions (X)


@query(GRAPH + """SELECT 'function_id_unique' AS rule, (SELECT count(*) FROM ref_functions WHERE graph_role = 'reference' AND ends_with(function_name, '3')) AS rows
UNION ALL SELECT 'edge_ends_exist', (SELECT count(*) FILTER (dst_name IN (SELECT function_name FROM ref_functions WHERE graph_role = 'reference_external')) FROM edges)
UNION ALL SELECT 'candidate_names_unique', (SELECT count(*) FROM listed WHERE case_id % 7 = 0 AND pos = 1) UNION ALL SELECT 'score_in_range', (SELECT count(*) FROM listed WHERE prior + CASE WHEN case_id % 9 = 0 THEN 5e-1 ELSE 0 END > 1)
UNION ALL SELECT 'anchors_accepted', (SELECT count(*) FROM part WHERE p_size > 10) UNION ALL SELECT 'confidence_in_range', (SELECT count(*) FROM part WHERE p_partkey % 10 = 0) UNION ALL SELECT 'schema_version_given', 2""")
def dq_validation(t: Tables) -> DataFrame:
    """X1, over the graph without its external functions, with bad rows of each kind."""
    functions = t.functions.where("graph_role = 'reference'").select(F.col("function_name").alias("function_id"))
    functions = functions.unionByName(functions.where(F.col("function_id").endswith("3")))
    edges = t.edges.select(F.col("src_name").alias("src_id"), F.col("dst_name").alias("dst_id"))
    listed = t.listed.withColumn("prior", F.col("prior") + F.when(F.col("case_id") % 9 == 0, 0.5).otherwise(0.0))
    listed = listed.unionByName(t.listed.where("case_id % 7 = 0 AND pos = 1").withColumn("prior", F.lit(0.5)))
    mappings = t.mappings.withColumn("confidence", F.when(F.col("query_function_id").startswith("P") & (F.col("pos") % 10 == 0), 1.5).otherwise(1.0))
    documents = t.spark.createDataFrame([("a", "0.1"), ("b", ""), ("c", None)], "name string, schema_version string")
    return X.validation_issues(functions, edges, listed, mappings, documents)


@query(GRAPH + """SELECT case_id, name, prior, CASE WHEN prior >= 69e-2 AND prior - coalesce(second, 0) >= 2e-2 THEN 'anchor_candidate' ELSE 'ambiguous' END AS decision
FROM (SELECT *, lead(prior) OVER (PARTITION BY case_id ORDER BY prior DESC, name) AS second, row_number() OVER (PARTITION BY case_id ORDER BY prior DESC, name) AS k FROM listed) WHERE k = 1""")
def anchor_select(t: Tables) -> DataFrame:
    """X2, with thresholds that the test tables reach."""
    return X.anchor_selection(t.listed, 0.69, 0.02)


@query(SCORED.replace("4e-2", "5e-2").replace("15e-3", "5e-2").replace("* 2e-3", "* 1e-1") + "SELECT case_id, name, graph_score, final_score, final_rank FROM ranked")
def strict_weights(t: Tables) -> DataFrame:
    """X3."""
    policy = X.strict_policy()
    done = runs.propagate_from_anchors(t.cases, t.neighbours, A.seed_anchors(t.mappings), t.listed, t.functions, t.pairs, policy)
    return done.scores.select("case_id", "name", "graph_score", "final_score", "final_rank")


@query(GRAPH + """, both_ways AS (SELECT case_id, 'callee' AS relation, pos, anchor FROM anchors WHERE relation = 'callee' UNION ALL SELECT case_id, 'caller', pos, anchor FROM anchors WHERE relation = 'callee'),
two_ways AS (SELECT architecture, src_name, dst_name, opt_levels FROM pairs UNION ALL SELECT architecture, dst_name, src_name, opt_levels FROM pairs WHERE starts_with(dst_name, 'P') AND right(dst_name, 1) IN ('0', '2', '4', '6', '8')),
met AS (SELECT k.case_id, k.pos, a.relation, a.anchor, opt_levels IS NOT NULL AS f, coalesce(list_contains(opt_levels, 'O0'), false) AS p FROM listed k JOIN cases c USING (case_id) JOIN both_ways a USING (case_id)
  LEFT JOIN two_ways w ON w.architecture = c.architecture AND w.src_name = CASE a.relation WHEN 'callee' THEN k.name ELSE a.anchor END AND w.dst_name = CASE a.relation WHEN 'callee' THEN a.anchor ELSE k.name END),
mutual AS (SELECT case_id, pos, count(*) AS n FROM (SELECT case_id, pos, anchor FROM met WHERE f GROUP BY ALL HAVING count(DISTINCT relation) = 2) GROUP BY ALL),
added AS (SELECT case_id, pos, count(*) FILTER (p) AS primary_matches, count(*) FILTER (f AND NOT p) AS auxiliary_matches, count(*) FILTER (NOT f) AS missing_anchor_edges FROM met GROUP BY ALL)
SELECT case_id, pos, name, coalesce(n, 0) AS mutual_edge_matches, round((coalesce(primary_matches, 0) * 5e-2 + coalesce(auxiliary_matches, 0) * 5e-2 - coalesce(missing_anchor_edges, 0) * 1e-1 + coalesce(n, 0) * 3e-2) * 1000000)::BIGINT AS graph_score
FROM listed LEFT JOIN added USING (case_id, pos) LEFT JOIN mutual USING (case_id, pos)""")  # fmt: skip
def mutual_edges(t: Tables) -> DataFrame:
    """The bonus of anchors that a candidate calls and is called by; parts with an even number call their suppliers back."""
    back = t.edges.where(F.col("dst_name").rlike("^P.*[02468]$"))
    edges = t.edges.unionByName(back.withColumns({"src_name": F.col("dst_name"), "dst_name": F.col("src_name")}))
    parts = t.neighbours.where("relation = 'callee'")
    policy = X.strict_policy(expansion_enabled=False)
    done = runs.propagate_from_anchors(t.cases, parts.unionByName(parts.withColumn("relation", F.lit("caller"))), A.seed_anchors(t.mappings), t.listed, t.functions, edges, policy)
    return done.scores.select("case_id", "pos", "name", "mutual_edge_matches", millionths("graph_score").alias("graph_score"))


@query(DECIDED + """, m AS (SELECT *, round(s1 - coalesce(s2, 0e0), 6) AS margin FROM stated),
p AS (SELECT *, row_number() OVER (PARTITION BY query_file, predicted, status0 ORDER BY margin DESC, case_id) AS place, count(*) OVER (PARTITION BY query_file, predicted, status0) AS rivals FROM m)
SELECT case_id, predicted AS predicted_function_name, CASE WHEN status0 = 'accepted' AND rivals > 1 AND NOT (place = 1 AND margin >= 15e-3) THEN 'deferred' ELSE status0 END AS resolved_status FROM p""")  # fmt: skip
def conflict_by_margin(t: Tables) -> DataFrame:
    """X4."""
    before = tabled(_run(t).decided())
    return X.conflicts_by_margin(before, POLICY).select("case_id", "predicted_function_name", "resolved_status")


@query(DECIDED + "SELECT name AS query_key, name AS reference_function_name FROM seeds UNION SELECT query_func, predicted FROM results WHERE status = 'accepted'")
def propagate_fixpoint(t: Tables) -> DataFrame:
    """Rounds of propagation until nothing is added. Customers are nobody's neighbours here, so the second round adds nothing to what the SQL has."""
    seeds = A.seed_anchors(t.mappings)
    step = lambda known: runs.propagate_from_anchors(t.cases, t.neighbours, known, t.listed, t.functions, t.pairs, POLICY).results
    return X.propagate(step, seeds)[0]


# Customers as each other's neighbours: of every four the first has its parts, the others know one another alone.
CHAIN = GRAPH + """,
case_r AS (SELECT case_id, query_func, architecture, case_id // 16 AS query_file FROM cases),
nb AS (SELECT case_id, relation, name FROM neighbours WHERE case_id % 4 = 0 UNION ALL SELECT case_id, CASE WHEN case_id % 4 = 2 THEN 'caller' ELSE 'callee' END, 'C' || (case_id - 1) FROM cases WHERE case_id % 4 > 0),
placed AS (SELECT 'S' || s_suppkey AS name, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier),
li AS (SELECT case_id, pos, name, prior FROM listed WHERE case_id % 4 = 0 UNION ALL SELECT case_id, n_nationkey, 'N' || n_nationkey, 5e-1 FROM cases, nation WHERE case_id % 2 = 1
  UNION ALL SELECT case_id, s_nationkey, name, 5e-1 FROM cases JOIN placed ON place = 1 + case_id // 4 % 3 WHERE case_id % 4 = 2),
kn1 AS MATERIALIZED (SELECT name AS key, name AS ref FROM seeds)""" + "".join(f""",
an{k} AS (SELECT DISTINCT case_id, relation, ref AS anchor FROM nb JOIN kn{k} ON key = nb.name),
sc{k} AS (SELECT l.case_id, l.name, l.pos, l.prior, count(anchor) AS n, count(*) FILTER (list_contains(opt_levels, 'O0')) AS p, count(opt_levels) AS met FROM li l JOIN case_r c USING (case_id) LEFT JOIN an{k} a USING (case_id) LEFT JOIN pairs q
  ON q.architecture = c.architecture AND q.src_name = CASE relation WHEN 'callee' THEN l.name ELSE anchor END AND q.dst_name = CASE relation WHEN 'callee' THEN anchor ELSE l.name END GROUP BY ALL),
fi{k} AS (SELECT *, round(prior + (p * 4e-2 + (met - p) * 15e-3 - (n - met) * 2e-3), 6) AS f FROM sc{k}),
rk{k} AS (SELECT *, row_number() OVER w AS r, lead(f) OVER w AS nxt FROM fi{k} WINDOW w AS (PARTITION BY case_id ORDER BY f DESC, p DESC, prior DESC, name DESC, pos)),
st{k} AS (SELECT query_file, query_func, name AS predicted FROM rk{k} JOIN case_r USING (case_id) WHERE r = 1 AND n > 0 AND p > 0 AND f - coalesce(nxt, 0e0) >= 15e-3),
ac{k} AS (SELECT query_func AS key, predicted AS ref FROM st{k} QUALIFY count(*) OVER (PARTITION BY query_file, predicted) = 1),
kn{k + 1} AS MATERIALIZED (SELECT key, ref FROM kn{k} UNION ALL SELECT key, ref FROM ac{k} ANTI JOIN kn{k} USING (key))""" for k in range(1, 6))  # fmt: skip


def _chain(t: Tables) -> runs.Propagated:
    k = F.col("case_id") % 4
    cases = t.cases.withColumn("query_file", F.floor(F.col("case_id") / 16))
    others = cases.where(k > 0).select("case_id", F.when(k == 2, "caller").otherwise("callee").alias("relation"), F.lit(0).alias("pos"), F.concat(F.lit("C"), (F.col("case_id") - 1).cast("string")).alias("name"))
    neighbours = t.neighbours.where(k == 0).unionByName(others)
    half = F.lit(0.5)
    nations = t.read("nation").select(F.col("n_nationkey").cast("int").alias("pos"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"))
    odd = cases.where("case_id % 2 = 1").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(24)))).join(nations, "pos").select("case_id", "pos", "name", half.alias("prior"))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    suppliers = t.read("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").cast("int").alias("pos"), place.alias("place")).where("place <= 3")
    even = cases.where(k == 2).select("case_id", (F.floor(F.col("case_id") / 4) % 3 + 1).cast("int").alias("place")).join(suppliers, "place").select("case_id", "pos", "name", half.alias("prior"))
    listed = t.listed.where(k == 0).select("case_id", "pos", "name", "prior").unionByName(odd).unionByName(even)
    return runs.propagate_in_rounds(cases, neighbours, A.seed_anchors(t.mappings), listed, t.functions, t.pairs, Policy(expansion_enabled=False))


@query(CHAIN + "SELECT key AS query_key, ref AS reference_function_name FROM kn6")
def propagate_rounds(t: Tables) -> DataFrame:
    """Four rounds at least, of which each scores only cases with a neighbour that has just been anchored."""
    return _chain(t).known


@query(REVIEW + """, every AS (SELECT *, coalesce(list_contains(reasons, 'no_candidates'), false) AS none FROM results),
rivals AS (SELECT query_file, predicted, list(query_func ORDER BY query_func) AS names FROM results WHERE status = 'conflict' GROUP BY ALL),
first AS (SELECT case_id, concat_ws('/', round(prior * 1000000)::BIGINT, round(graph_score * 1000000)::BIGINT, round(final_score * 1000000)::BIGINT) AS scores, array_to_string(evidence, ';') AS evidence FROM ranked WHERE final_rank = 1)
SELECT case_id, query_func AS query_function_id, CASE WHEN none THEN 'rejected' ELSE status END AS status, predicted AS reference_function_name, round(s1 * 1000000)::BIGINT AS confidence, coalesce(scores, '') AS scores, coalesce(evidence, '') AS evidence,
  coalesce(CASE WHEN status = 'conflict' THEN array_to_string(list_filter(names, lambda x: x <> query_func), ';') END, '') AS conflicts, CASE WHEN case_id % 2 = 0 THEN 'remain_deferred' END AS llm_class
FROM every LEFT JOIN rivals USING (query_file, predicted) LEFT JOIN first USING (case_id)""")  # fmt: skip
def mapping_export(t: Tables) -> DataFrame:
    """Fields of each mapping document, read back from its JSON."""
    done = _run(t).kept(1)
    advice = t.cases.where("case_id % 2 = 0").select("case_id", F.lit('{"classification": "remain_deferred"}').alias("analysis"))
    m = F.from_json("mapping", "struct<query_function_id:string,final_candidate:struct<reference_function_name:string>,status:string,confidence:double,scores:struct<retrieval_prior:double,graph_score:double,final_score:double>,evidence:array<string>,conflicts:array<string>,llm_evidence:struct<classification:string>>")
    rows = X.mapping_export(done.results, done.top(1), advice).withColumn("m", m)
    s = F.col("m.scores")
    return rows.select("case_id", "m.query_function_id", "m.status", "m.final_candidate.reference_function_name", millionths("m.confidence").alias("confidence"), F.when(s.isNotNull(), F.concat_ws("/", *[millionths(s[c]) for c in ("retrieval_prior", "graph_score", "final_score")])).otherwise("").alias("scores"),
        joined("m.evidence").alias("evidence"), joined("m.conflicts").alias("conflicts"), F.col("m.llm_evidence.classification").alias("llm_class"))


@query(DECIDED + """, loose AS (SELECT DISTINCT case_id FROM neighbours n WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.case_id = n.case_id AND a.relation = n.relation AND a.anchor = n.name)),
claims AS (SELECT query_file, predicted, count(*) AS c FROM results WHERE status <> 'deferred' GROUP BY ALL),
w AS (SELECT case_id, list_filter([CASE WHEN status = 'deferred' THEN 'deferred' END, CASE WHEN status <> 'deferred' AND c > 1 THEN 'conflict' END, CASE WHEN s1 - coalesce(s2, 0e0) < 15e-3 THEN 'low_margin' END,
  CASE WHEN case_id IN (SELECT case_id FROM loose) THEN 'custom_suspected' END], lambda x: x IS NOT NULL) AS t FROM results LEFT JOIN claims USING (query_file, predicted))
SELECT case_id, array_to_string(t, ';') AS triggers FROM w WHERE len(t) > 0""")  # fmt: skip
def review_triggers(t: Tables) -> DataFrame:
    """X7."""
    done = _run(t)
    return X.review_triggers(done.results, POLICY, X.unanchored_neighbours(t.neighbours, done.anchors)).select("case_id", joined("triggers").alias("triggers"))


@query(DECIDED + f"""SELECT case_id, CASE WHEN status = 'conflict' THEN 1 ELSE CASE {CATEGORY} WHEN 'ambiguous_candidate_tie' THEN 2 WHEN 'needs_more_graph_anchors' THEN 3 ELSE 4 END END AS review_priority FROM results WHERE status <> 'accepted'""")
def human_report(t: Tables) -> DataFrame:
    """X8."""
    return review.human_report(runs.review_run(_run(t), _features(t), POLICY)[0]).select("case_id", "review_priority")


from linkweave.plans import source_queries  # noqa: E402, F401  registers its own
