"""The smallest whole run, against golden values (FIXTURES.md F2 to F4), and its rules."""

from __future__ import annotations

from linkweave.plans.runs import score_query_graph
from linkweave.policy import Policy

RETRIEVAL = "query_pos int, query_id string, query_name string, architecture string, pos int, name string, prior double, rank int"


def edges(spark, rows, arch="x86_64"):
    full = [(*r, "calls", "reference", "Lua_547", arch, "nostrip") if len(r) == 3 else (*r[:3], "calls", "reference", "Lua_547", r[3], "nostrip") for r in rows]
    return spark.createDataFrame(full, "src_name string, dst_name string, opt_level string, edge_type string, graph_role string, lua_version string, architecture string, strip_mode string")


def mappings(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pos int, query_function_id string, query_function_name string, reference_function_name string, status string")


def toy(spark, ref=None, graph=None, anchors=None, retrieval=None, expected=None, policy=None):
    retrieval = retrieval or [(0, "q", None, None, k, n, p, k + 1) for k, (n, p) in enumerate([("llex", 0.711), ("luaV_execute", 0.709), ("luaD_rawrunprotected", 0.641)])]
    ref = ref or [("luaV_execute", "luaD_precall", "O0"), ("luaV_execute", "luaT_trybinTM", "O0"), ("llex", "luaX_newstring", "O0"), ("llex", "inclinenumber", "O0")]
    graph = graph or [("q", "a", "calls"), ("q", "b", None), ("q", "c", "calls"), ("q", "d", "reads"), ("", "q", "calls")]
    anchors = anchors or [("a", "", "luaD_precall", "accepted"), ("b", "", "luaT_trybinTM", "accepted"), ("c", "", "nothing", "deferred")]
    want = spark.createDataFrame(expected or [("q", "luaV_execute")], "query_id string, expected_function string")
    return score_query_graph(spark.createDataFrame(retrieval, RETRIEVAL), spark.createDataFrame(graph, "src string, dst string, edge_type string"), mappings(spark, anchors), edges(spark, ref), want, policy or Policy.minimal())


def test_golden(spark):
    ranked, results, metrics = toy(spark)
    rows = {r["name"]: r for r in ranked.collect()}
    assert {n: (r["final_score"], r["graph_score"], r["primary_matches"], r["auxiliary_matches"], r["missing_anchor_edges"], r["unknown_extra_neighbors"], r["final_rank"]) for n, r in rows.items()} == {
        "luaV_execute": (0.789, 0.08, 2, 0, 0, 1, 1), "llex": (0.707, -0.004, 0, 0, 2, 1, 2), "luaD_rawrunprotected": (0.637, -0.004, 0, 0, 2, 1, 3),
    }
    assert rows["luaV_execute"]["evidence"] == ["primary_callee_anchor_match:luaV_execute->luaD_precall", "primary_callee_anchor_match:luaV_execute->luaT_trybinTM", "unanchored_query_callee:c"]
    assert all(r["custom_suspected"] for r in rows.values())
    assert results.collect()[0]["propagation_top1"] == "luaV_execute"
    assert tuple(metrics.collect()[0]) == (1, 0.0, 1.0, 1, 0)


def test_extra_edge_makes_third_candidate_gain(spark):
    ref = [("luaV_execute", "luaD_precall", "O0"), ("luaV_execute", "luaT_trybinTM", "O0"), ("luaD_rawrunprotected", "luaD_precall", "O0")]
    assert {r["name"]: r["final_score"] for r in toy(spark, ref)[0].collect()}["luaD_rawrunprotected"] == 0.679


def test_ties_keep_input_order(spark):
    retrieval = [(0, "q", None, None, k, n, 0.5, k + 1) for k, n in enumerate(["b", "z", "a"])]
    ranked = toy(spark, retrieval=retrieval)[0]
    assert [r["name"] for r in ranked.orderBy("final_rank").collect()] == ["b", "z", "a"]


def test_architecture_is_not_normalised_and_defaults(spark):
    ref = [("x", "luaD_precall", "O0", "x86_64"), ("x", "luaT_trybinTM", "O0", "aarch64")]
    rows = [(0, "q", None, "arm64", 0, "x", 0.5, 1), (1, "p", None, None, 0, "x", 0.5, 1)]
    ranked = toy(spark, ref, graph=[("q", "a", "calls"), ("p", "a", "calls"), ("p", "b", "calls")], retrieval=rows)[0]
    assert {r["case_id"]: (r["primary_matches"], r["missing_anchor_edges"]) for r in ranked.collect()} == {"q": (0, 1), "p": (1, 1)}


def test_self_loop_counts_in_both_directions(spark):
    ranked = toy(spark, graph=[("q", "q", "calls")])[0]
    assert {r["unknown_extra_neighbors"] for r in ranked.collect()} == {2}


def test_auxiliary_levels_and_external_anchor(spark):
    ref = [("x", "luaD_precall", "O3"), ("x", "luaD_precall", "O2")]
    ranked = toy(spark, ref, graph=[("q", "a", "calls")], retrieval=[(0, "q", None, None, 0, "x", 0.5, 1)])[0]
    row = ranked.collect()[0]
    assert (row["auxiliary_matches"], row["final_score"], row["evidence"]) == (1, 0.515, ["aux_callee_anchor_match:x->luaD_precall:O2,O3"])


def test_two_ids_with_one_anchor_count_twice(spark):
    anchors = [("a", "", "luaD_precall", "accepted"), ("b", "", "luaD_precall", "accepted"), ("b", "", "luaD_precall", "accepted")]
    rows = {r["name"]: r for r in toy(spark, anchors=anchors)[0].collect()}
    assert rows["luaV_execute"]["primary_matches"] == 2


def test_last_accepted_mapping_wins(spark):
    anchors = [("a", "", "luaT_trybinTM", "accepted"), ("a", "", "luaD_precall", "accepted"), ("a", "", "none", "deferred"), ("a", "", "", "accepted")]
    rows = {r["name"]: r for r in toy(spark, anchors=anchors, graph=[("q", "a", "calls")])[0].collect()}
    assert rows["luaV_execute"]["evidence"] == ["primary_callee_anchor_match:luaV_execute->luaD_precall"]


def test_queries_without_candidates_are_left_out(spark):
    retrieval = [(0, "q", None, None, 0, "x", 0.5, 1), (1, "p", None, None, None, None, None, None)]
    _, results, metrics = toy(spark, retrieval=retrieval, expected=[("q", "x"), ("p", "y")])
    assert results.count() == 1
    assert metrics.collect()[0]["expected_count"] == 1


def test_missing_rank_is_last(spark):
    retrieval = [(0, "q", None, None, 0, "x", 0.9, None), (0, "q", None, None, 1, "y", 0.1, 7)]
    assert toy(spark, retrieval=retrieval)[1].collect()[0]["retrieval_top1"] == "y"


def test_no_expected_names_gives_null_shares(spark):
    metrics = toy(spark, expected=[("other", "x")])[2]
    assert tuple(metrics.collect()[0]) == (0, None, None, 0, 0)
