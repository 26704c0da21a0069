"""Anchors, expansion, scores, decisions and conflicts of whole runs, and the rules that change their results."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from linkweave.operators import anchors as A
from linkweave.operators import candidates as C
from linkweave.operators import decide, metrics, scoring, store
from linkweave.operators import extensions as X
from linkweave.plans.runs import evaluate_hybrid, propagate_from_anchors, propagate_in_rounds
from linkweave.policy import Policy
from tests.test_minimal import edges

CASE = "case_id string, mode string, query_file string, query_func string, lua_version string, architecture string, expected_function string"


class World:
    def __init__(self, spark, refs, neighbours, listed, seeds=(), cases=None, external=()):
        self.edges = edges(spark, refs)
        names = {n for r in refs for n in r[:2]} | {n for *_, n in neighbours if n}
        self.functions = spark.createDataFrame([(n, "reference_external" if n in external else "reference") for n in sorted(names) if not n.startswith("?")] or [("-", "reference")], "function_name string, graph_role string")
        self.neighbours = spark.createDataFrame(neighbours or [], "case_id string, relation string, pos int, name string")
        self.listed = spark.createDataFrame([(c, k, n, p) for c, k, n, p in listed], "case_id string, pos int, name string, prior double")
        self.seeds = spark.createDataFrame(list(seeds), "query_key string, reference_function_name string")
        ids = sorted({c for c, *_ in listed} | {c for c, *_ in neighbours})
        self.cases = spark.createDataFrame([(c, "m", "f", f"?{c}", "Lua_547", "x86_64", (cases or {}).get(c)) for c in ids], CASE)

    def propagate(self, **policy):
        return propagate_from_anchors(self.cases, self.neighbours, self.seeds, self.listed, self.functions, self.edges, Policy(**policy))

    def hybrid(self, **policy):
        return evaluate_hybrid(self.cases, self.neighbours, self.listed, self.functions, self.edges, Policy.hybrid(**policy))


def by(rows, key, *values):
    return {r[key]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in rows.collect()}


def test_golden_tie_goes_to_larger_names(spark):
    names = ["auxsort", "checktab", "luaL_argerror", "luaL_checktype", "luaL_len", "lua_settop", "lua_type"]
    w = World(spark, [("sort", n, "O0") for n in names], [("1", "caller", 0, "sort")], [], [("sort", "sort")], {"1": "lua_settop"})
    done = w.propagate()
    row = done.results.collect()[0]
    assert row["top_tied_candidates"] == sorted(names, reverse=True)
    assert (row["status"], row["status_reasons"]) == ("deferred", ["low_score_margin", "multiple_candidates_same_final_score"])
    assert row["expected_final_rank"] == 2
    assert {r["final_score"] for r in done.ranked.collect()} == {0.69}


def test_no_anchors(spark):
    w = World(spark, [("x", "y", "O0")], [("1", "callee", 0, "?sub")], [("1", 0, "luaU_undump", 0.765263)])
    row = w.propagate().results.collect()[0]
    assert (row["status"], row["status_reasons"], row["predicted_function_name"]) == ("deferred", ["no_anchor_evidence", "insufficient_primary_graph_matches"], "luaU_undump")


def test_no_candidates(spark):
    w = World(spark, [("x", "y", "O0")], [("1", "callee", 0, "?sub")], [])
    row = w.propagate().results.collect()[0]
    assert (row["status"], row["status_reasons"], row["predicted_function_name"], row["candidate_count"]) == ("deferred", ["no_candidates"], None, 0)


def test_lone_candidate_is_accepted_and_hub_passes_one(spark):
    hub = [(f"a{k}", "x", "O0") for k in range(73)]
    w = World(spark, hub, [("1", "caller", k, f"a{k}") for k in range(73)], [("1", 0, "x", 0.5)], [(f"a{k}", f"a{k}") for k in range(73)])
    done = w.propagate(expansion_enabled=False)
    assert by(done.results, "case_id", "status", "top_score") == {"1": ("accepted", 3.42)}
    assert len(done.ranked.collect()[0]["evidence"]) == 30


def test_expansion_counts_every_level_and_scorer_one(spark):
    w = World(spark, [("x", "a", "O0"), ("x", "a", "O2"), ("x", "a", "O3"), ("y", "a", "O2"), ("y", "a", "O3")], [("1", "callee", 0, "a")], [], [("a", "a")])
    names = w.functions.selectExpr("function_name as name")
    found = A.anchored_neighbours(w.neighbours, w.cases, w.seeds, names, Policy())
    grown = C.expansion(w.cases, found, store.pair_levels(w.edges), names, C.retrieval_candidates(w.listed), Policy())
    assert by(grown, "name", "primary_support", "auxiliary_support") == {"x": (1, 2), "y": (0, 2)}
    assert by(w.propagate().ranked, "name", "primary_matches", "auxiliary_matches") == {"x": (1, 0), "y": (0, 1)}


def test_expanded_ranks_go_on_from_different_names(spark):
    w = World(spark, [("z", "a", "O0"), ("y", "a", "O0")], [("1", "callee", 0, "a")], [("1", 0, "x", 0.5), ("1", 1, None, 0.4), ("1", 2, "x", 0.3)], [("a", "a")])
    done = w.propagate()
    assert sorted((r["pos"], r["name"], r["rank"]) for r in done.candidates.collect()) == [(0, "x", 1), (2, "x", 3), (3, "z", 2), (4, "y", 3)]
    assert by(done.results, "case_id", "candidate_count", "retrieval_candidate_count", "expanded_candidate_count") == {"1": (4, 1, 2)}


def test_expansion_leaves_out_external_and_retrieved_names_and_keeps_the_limit(spark):
    refs = [(n, "a", "O0") for n in ("ext", "x", "b1", "b2", "b3")]
    w = World(spark, refs, [("1", "callee", 0, "a")], [("1", 0, "x", 0.5)], [("a", "a")], external=("ext",))
    assert sorted(r["name"] for r in w.propagate(expansion_limit=2).candidates.collect()) == ["b2", "b3", "x"]


def test_seeds_skip_membership_and_prefix_tests(spark):
    neighbours = [("1", "callee", 0, "lua_a"), ("1", "callee", 1, "lua_b"), ("1", "callee", 2, "?1"), ("1", "callee", 3, ""), ("1", "callee", 4, None), ("1", "callee", 5, "c"), ("1", "callee", 6, "alias")]
    w = World(spark, [("lua_a", "c", "O0"), ("lua_b", "c", "O0")], neighbours, [("1", 0, "x", 0.5)], [("lua_a", "not_known"), ("alias", "c")])
    done = w.propagate(allow_visible_names=True, exclude_prefixes=("lua_",))
    got = sorted((r["pos"], r["anchor"], r["source"]) for r in done.anchors.collect())
    assert got == [(0, "not_known", "seed_anchor"), (5, "c", "visible_reference_name_anchor")]


def test_one_anchor_in_both_relations_counts_twice(spark):
    w = World(spark, [("x", "a", "O0"), ("a", "x", "O0")], [("1", "callee", 0, "a"), ("1", "callee", 1, "a"), ("1", "caller", 0, "a")], [("1", 0, "x", 0.5)], [("a", "a")])
    assert by(w.propagate().ranked, "name", "primary_matches")["x"] == 2


def test_hybrid_first_of_list_can_be_expanded(spark):
    w = World(spark, [("x", "a", "O0")], [("1", "callee", 0, "a"), ("2", "callee", 0, "?")], [], cases={"1": "x", "2": "q"})
    done = w.hybrid(expansion_enabled=True)
    assert by(done.results, "case_id", "retrieval_top1", "propagation_top1") == {"1": ("x", "x"), "2": ("", "")}
    off = w.hybrid()
    assert by(off.results, "case_id", "retrieval_top1") == {"1": "", "2": ""}


def test_conflicts_among_accepted_only(spark):
    refs = [("x", "a", "O0"), ("y", "b", "O0")]
    neighbours = [(c, "callee", 0, "a") for c in "12"] + [("3", "callee", 0, "b"), ("4", "callee", 0, "?")]
    listed = [(c, 0, "x", 0.9) for c in "124"] + [("3", 0, "y", 0.9)]
    w = World(spark, refs, neighbours, listed, [("a", "a"), ("b", "b")])
    done = w.propagate(expansion_enabled=False)
    assert by(done.results, "case_id", "status") == {"1": "conflict", "2": "conflict", "3": "accepted", "4": "deferred"}
    assert by(done.results, "case_id", "status_reasons")["1"] == ["duplicate_accepted_mapping_in_query_scope"]
    before = decide.case_results(w.cases, done.ranked, done.anchors, Policy())
    assert by(X.conflicts_by_margin(before, Policy()), "case_id", "resolved_status") == {"1": "accepted", "2": "deferred", "3": "accepted", "4": "deferred"}


@pytest.mark.parametrize("second, deferred", [(0.675, True), (0.6, False)])
def test_margin_uses_raw_doubles(spark, second, deferred):
    w = World(spark, [("x", "a", "O0")], [("1", "callee", 0, "a")], [("1", 0, "x", 0.65), ("1", 1, "y", round(second + 0.002, 6))], [("a", "a")])
    row = w.propagate(expansion_enabled=False).results.collect()[0]
    assert (row["status"] == "deferred") is deferred
    assert 0.69 - 0.675 < 0.015


def test_summaries_of_nothing(spark):
    w = World(spark, [("x", "a", "O0")], [("1", "callee", 0, "a")], [("1", 0, "x", 0.5)], [("a", "a")])
    done = w.propagate()
    none = done.results.where("false")
    assert tuple(metrics.status_summary(none).collect()[0]) == (0, 0, 0, 0, None, None, None)
    assert tuple(metrics.summary(none).collect()[0]) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0)
    assert tuple(metrics.status_summary(done.results).collect()[0])[4:] == (None, None, None)


def test_every_accepted_prediction_is_unique_and_ranks_are_dense(spark):
    refs = [(f"f{k}", f"g{k % 7}", "O0" if k % 3 else "O2") for k in range(60)]
    neighbours = [(str(c), "callee", k, f"g{(c + k) % 7}") for c in range(20) for k in range(3)]
    listed = [(str(c), k, f"f{(7 * c + k) % 60}", round(0.6 + k / 100, 6)) for c in range(20) for k in range(4)]
    done = World(spark, refs, neighbours, listed, [(f"g{k}", f"g{k}") for k in range(7)]).propagate()
    rows = done.ranked.collect()
    for c in {r["case_id"] for r in rows}:
        assert sorted(r["final_rank"] for r in rows if r["case_id"] == c) == list(range(1, sum(r["case_id"] == c for r in rows) + 1))
    assert all(abs(r["final_score"] - r["prior"] - r["graph_score"]) < 1e-6 for r in rows)
    taken = [(r["query_file"], r["predicted_function_name"]) for r in done.results.collect() if r["status"] == "accepted"]
    assert len(taken) == len(set(taken))


def test_propagation_reaches_a_fixpoint(spark):
    w = World(spark, [("x", "a", "O0"), ("y", "x", "O0")], [("1", "callee", 0, "a"), ("2", "callee", 0, "?1")], [("1", 0, "x", 0.9), ("2", 0, "y", 0.9)], [("a", "a")])
    step = lambda known: propagate_from_anchors(w.cases, w.neighbours, known, w.listed, w.functions, w.edges, Policy(expansion_enabled=False)).results
    known, rounds = X.propagate(step, w.seeds)
    assert {(r[0], r[1]) for r in known.collect()} == {("a", "a"), ("?1", "x"), ("?2", "y")}
    assert rounds == 3


def test_rounds_score_only_what_has_changed(spark):
    """Three chains, one of which frees a name for another when it moves on, against scoring all in each round."""
    refs = [(f"f{k}", f"f{k + 1}", "O0") for k in range(6)] + [("g", "a", "O0"), ("h", "f1", "O0"), ("h", "f5", "O0")]
    neighbours = [(str(k), "callee", 0, f"?{k + 1}") for k in range(5)] + [("5", "callee", 0, "a0"), ("8", "callee", 0, "a"), ("9", "callee", 0, "a"), ("9", "callee", 1, "?4"), ("9", "callee", 2, "?0")]
    listed = [(str(k), 0, f"f{k}", 0.5) for k in range(6)] + [("8", 0, "g", 0.5), ("9", 0, "g", 0.5), ("9", 1, "h", 0.49)]
    w = World(spark, refs, neighbours, listed, [("a0", "f6"), ("a", "a")])
    policy = Policy(expansion_enabled=False)
    step = lambda known: propagate_from_anchors(w.cases, w.neighbours, known, w.listed, w.functions, w.edges, policy).results
    want, _ = X.propagate(step, w.seeds)
    done = propagate_in_rounds(w.cases, w.neighbours, w.seeds, w.listed, w.functions, w.edges, policy)
    assert sorted(map(tuple, done.known.collect())) == sorted(map(tuple, want.select("query_key", "reference_function_name").collect()))
    assert by(done.results, "case_id", "status", "predicted_function_name") == by(step(want), "case_id", "status", "predicted_function_name")
    assert done.scored[0] == 8 and len(done.scored) > 5 and max(done.scored[1:]) <= 2


def test_tables_are_removed(spark):
    from pathlib import Path

    from linkweave import checkpoints

    exists = lambda df: Path(df.stored_at.removeprefix("file:")).exists()
    with checkpoints.released(spark) as keep:
        one, two = checkpoints.tabled(spark.range(3)), keep(checkpoints.tabled(spark.range(4)))
        with checkpoints.released(spark) as inner:
            three = inner(checkpoints.tabled(spark.range(5)))
            four = checkpoints.tabled(spark.range(6))
        assert exists(one) and exists(three) and not exists(four)
    assert not exists(one) and not exists(three) and two.count() == 4
    checkpoints.discard(two)
    assert not exists(two)


def test_propagation_has_no_most_rounds(spark):
    """A chain in which each round accepts the next function."""
    chain = spark.createDataFrame([(f"q{k}", f"q{k + 1}", f"r{k + 1}") for k in range(13)], "was string, query_func string, predicted_function_name string")
    step = lambda known: chain.join(known, chain["was"] == known["query_key"]).select("query_func", "predicted_function_name").withColumn("status", F.lit("accepted"))
    known, rounds = X.propagate(step, spark.createDataFrame([("q0", "r0")], "query_key string, reference_function_name string"))
    assert {(r[0], r[1]) for r in known.collect()} == {(f"q{k}", f"r{k}") for k in range(14)}
    assert rounds == 14


def test_supporting_edges_of_those_that_stay(spark):
    w = World(spark, [("x", "a", "O0"), ("x", "a", "O2"), ("y", "a", "O0"), ("b", "x", "O3")], [("1", "callee", 0, "a"), ("1", "caller", 0, "b")], [], [("a", "a"), ("b", "b")])
    done = w.propagate(expansion_limit=1)
    pairs, names = store.pair_levels(w.edges), w.functions.selectExpr("function_name as name")
    top = C.expansion_top(C.expansion(w.cases, done.anchors, pairs, names, C.retrieval_candidates(w.listed), Policy()), Policy(expansion_limit=1))
    got = {r["name"]: [tuple(x) for x in r["supporting_edges"]] for r in C.supporting_edges(done.found, top).collect()}
    assert got == {"x": [("anchor_calls_candidate", "b", "O3"), ("candidate_calls_anchor", "a", "O0"), ("candidate_calls_anchor", "a", "O2")]}


def test_mutual_bonus(spark):
    w = World(spark, [("x", "a", "O0"), ("a", "x", "O2"), ("x", "b", "O0"), ("y", "a", "O0")], [("1", "callee", 0, "a"), ("1", "callee", 1, "b"), ("1", "caller", 0, "a")], [("1", 0, "x", 0.5), ("1", 1, "y", 0.5)], [("a", "a"), ("b", "b")])
    done = propagate_from_anchors(w.cases, w.neighbours, w.seeds, w.listed, w.functions, w.edges, X.strict_policy(expansion_enabled=False))
    assert by(done.ranked, "name", "mutual_edge_matches", "graph_score") == {"x": (1, 0.18), "y": (0, -0.15)}


def test_triggers_and_export(spark):
    import json

    refs = [("x", "a", "O0"), ("y", "b", "O0")]
    neighbours = [(c, "callee", 0, "a") for c in "12"] + [("3", "callee", 0, "b"), ("4", "callee", 0, "?")]
    w = World(spark, refs, neighbours, [(c, 0, "x", 0.9) for c in "12"] + [("3", 0, "y", 0.9)], [("a", "a"), ("b", "b")])
    done = w.propagate(expansion_enabled=False)
    assert by(X.review_triggers(done.results, Policy(), X.unanchored_neighbours(w.neighbours, done.anchors)), "case_id", "triggers") == {"1": ["conflict"], "2": ["conflict"], "4": ["deferred", "custom_suspected"]}
    advice = spark.createDataFrame([("3", '{"classification": "prefer_candidate"}'), ("4", None)], "case_id string, analysis string")
    got = {r["case_id"]: json.loads(r["mapping"]) for r in X.mapping_export(done.results, done.ranked, advice).collect()}
    assert got["1"]["conflicts"] == ["?2"] and got["3"]["conflicts"] == [] and got["4"]["status"] == "rejected" and got["4"]["scores"] is None
    assert got["3"]["llm_evidence"] == {"classification": "prefer_candidate"} and got["1"]["llm_evidence"] is None
    assert got["3"]["scores"] == {"retrieval_prior": 0.9, "graph_score": 0.04, "final_score": 0.94} and got["3"]["final_candidate"] == {"reference_function_name": "y"}
    plain = {r["case_id"]: json.loads(r["mapping"]) for r in X.mapping_export(done.results).collect()}
    assert plain["3"]["evidence"] == [] and plain["3"]["status"] == "accepted"


def _random_world(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{k}" for k in range(40)]
    refs = {(rnd.choice(names[:12] if rnd.random() < 0.6 else names), rnd.choice(names[:4] if rnd.random() < 0.5 else names), rnd.choice(["O0", "O2", "O3"])) for _ in range(260)}
    cases = [str(k) for k in range(25)]
    neighbours = [(c, r, k, n) for c in cases for r in ("callee", "caller") for k, n in enumerate(dict.fromkeys(rnd.choice(names[:6] if rnd.random() < 0.7 else names) for _ in range(rnd.randint(0, 4))))]
    listed = [(c, k, n, round(rnd.random(), 3)) for c in cases for k, n in enumerate(rnd.choice(names) for _ in range(rnd.randint(0, 4)))]
    return World(spark, sorted(refs), neighbours, listed, [(n, n) for n in names], external=("n3", "n17"))


@pytest.mark.parametrize(("seed", "limit", "bonus"), [(1, 2, 0.0), (2, 7, 0.03)])
def test_hubs_change_no_result(spark, seed, limit, bonus):
    w, tops = _random_world(spark, seed), []
    for degree in (10**9, 6, 0):
        done = w.propagate(expansion_limit=limit, hub_degree=degree, mutual_bonus=bonus)
        assert degree != 6 or not C.hubs(done.anchors, done.cases, done.pairs, done.policy).isEmpty()
        tops.append(sorted(done.ranked.select("case_id", "name", "pos", "final_rank", "primary_matches", "auxiliary_matches", "missing_anchor_edges", "final_score", F.to_json("evidence")).collect(), key=str))
    assert tops[0] == tops[1] == tops[2] and tops[0]


def test_a_hub_is_not_multiplied_by_its_cases(spark):
    """A name that 20,000 others call anchors 1,000 cases: 20 million edges meet cases without a bound."""
    callers, cases, limit = 20_000, 1_000, 80
    pairs = spark.range(callers).select(F.lit("Lua_547").alias("lua_version"), F.lit("x86_64").alias("architecture"), F.concat(F.lit("f"), "id").alias("src_name"), F.lit("hub").alias("dst_name"), F.when(F.col("id") % 3 == 0, F.array(F.lit("O0"), F.lit("O2"))).otherwise(F.array(F.lit("O2"))).alias("opt_levels"))
    case = spark.range(cases).select("id", F.concat(F.lit("c"), "id").alias("case_id"), F.lit("m").alias("mode"), F.lit("f").alias("query_file"), F.lit("?").alias("query_func"), F.lit("Lua_547").alias("lua_version"), F.lit("x86_64").alias("architecture"))
    anchors = case.select("case_id", F.lit("callee").alias("relation"), F.lit("hub").alias("anchor"), F.lit(0).alias("pos"), F.lit("hub").alias("query_name"))
    retrieved = case.select("case_id", F.concat(F.lit("f"), F.col("id") * 3).alias("name"))
    names = spark.range(callers).select(F.concat(F.lit("f"), "id").alias("name"))
    found = C.bounded_support(case, anchors, pairs, names, retrieved, Policy())
    assert found.count() <= cases * (limit + 2)
    top = C.expansion_top(C.expansion(case, anchors, pairs, names, retrieved, Policy(), C.agreement(found, Policy())), Policy())
    best = sorted((f"f{k}" for k in range(0, callers, 3)), reverse=True)
    got = {r.case_id: r.names for r in top.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names")).collect()}
    assert len(got) == cases
    assert all(got[f"c{k}"] == [n for n in best if n != f"f{k * 3}"][:limit] for k in range(cases))


def test_a_dear_anchor_is_counted_once_for_its_cases(spark):
    """An anchor below hub_degree that many cases share is a hub as well, and the best names stay the same."""
    callers, cases, limit = 200, 40, 5
    pairs = spark.range(callers).select(F.lit("Lua_547").alias("lua_version"), F.lit("x86_64").alias("architecture"), F.concat(F.lit("f"), "id").alias("src_name"), F.lit("hub").alias("dst_name"), F.array(F.lit("O0"), F.lit("O2")).alias("opt_levels"))
    pairs = pairs.unionByName(pairs.where("src_name < 'f12'").withColumn("dst_name", F.lit("low")))
    case = spark.range(cases).select("id", F.concat(F.lit("c"), "id").alias("case_id"), F.lit("Lua_547").alias("lua_version"), F.lit("x86_64").alias("architecture"))
    anchors = case.select("case_id", F.lit("callee").alias("relation"), F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("hub"), F.lit("low"))).otherwise(F.array(F.lit("hub")))).alias("anchor"), F.lit(0).alias("pos"), F.lit("q").alias("query_name"))
    retrieved = case.select("case_id", F.concat(F.lit("f"), F.col("id") * 3).alias("name"), F.lit(0).alias("pos"))
    names = spark.range(callers).where("id % 5 > 0").select(F.concat(F.lit("f"), "id").alias("name"))
    got = []
    for rows in (10**9, 100):
        policy = Policy(expansion_limit=limit, hub_rows=rows)
        assert C.hubs(anchors, case, pairs, policy).count() == (0 if rows > 100 else 2)
        found = C.best(case, anchors, pairs, names, retrieved, policy)
        assert found.where("NOT retrieved").count() == cases * limit and found.where("retrieved").count() == cases
        got.append(sorted(found.select("case_id", "name", "retrieved", "place", "primary_matches", "auxiliary_matches", "auxiliary_support", "retrieved_names", "last_pos").collect(), key=str))
    assert got[0] == got[1]


def _planned(monkeypatch, found):
    """The plan of what found() writes last."""
    plans, write = [], C.tabled

    def tabled(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(C, "tabled", tabled)
    found()
    return plans[-1]


def test_names_of_cases_are_not_dealt_out_for_their_hubs(spark, monkeypatch):
    """Sums of hubs meet the names where these are counted: one window, and no shuffle by set and name, even if Spark would broadcast nothing."""
    w = _random_world(spark, 3)
    anchors = A.anchored_neighbours(w.neighbours, w.cases, w.seeds, store.reference_names(w.functions), Policy())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _planned(monkeypatch, lambda: C.best(w.cases, anchors, store.pair_levels(w.edges), store.reference_names(w.functions), C.retrieval_candidates(w.listed), Policy(hub_degree=6)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\(hub_set#\d+L?, name", plan)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_expanded_names_are_made_from_lists(spark, monkeypatch, most):
    """All expanded names, as expansion() has them, with and without hubs."""
    monkeypatch.setattr(C, "BROADCAST_ROWS", most)
    w = _random_world(spark, 4)
    names, retrieved, pairs = store.reference_names(w.functions), C.retrieval_candidates(w.listed), store.pair_levels(w.edges)
    anchors = A.anchored_neighbours(w.neighbours, w.cases, w.seeds, names, Policy())
    columns = ("case_id", "name", "primary_support", "auxiliary_support")
    want = sorted(C.expansion(w.cases, anchors, pairs, names, retrieved, Policy()).select(*columns).collect(), key=str)
    for degree in (6, 10**9):
        got = C.expanded_names(w.cases, anchors, pairs, names, retrieved, Policy(hub_degree=degree))
        assert got.columns == list(columns) and sorted(got.collect(), key=str) == want and want


def test_all_evidence_stays_where_its_case_is(spark):
    """Evidence of every candidate, with hubs and without, is what the edges looked up for each name give; a task holds a bounded number of rows, and lists are dealt by case once."""
    edges = spark.createDataFrame([(f"s{k}", f"p{k % 7}", "O0" if k % 3 else "O2") for k in range(700)] + [("n0", f"s{k}", "O0") for k in range(0, 700, 2)], "src_name string, dst_name string, opt_level string")
    edges = edges.withColumns({"edge_type": F.lit("calls"), "graph_role": F.lit("reference"), "lua_version": F.lit("Lua_547"), "architecture": F.lit("x86_64"), "strip_mode": F.lit("nostrip")})
    pairs = store.pair_levels(edges)
    cases = spark.range(60).select(F.col("id").alias("case_id"), F.lit("Lua_547").alias("lua_version"), F.lit("x86_64").alias("architecture"))
    callees = cases.select("case_id", F.lit("callee").alias("relation"), F.explode(F.array(*[F.concat(F.lit("p"), ((F.col("case_id") + k) % 7).cast("string")) for k in range(2)])).alias("anchor"))
    anchors = callees.unionByName(cases.where("case_id % 4 > 0").select("case_id", F.lit("caller").alias("relation"), F.lit("n0").alias("anchor")))
    anchors = anchors.withColumns({"pos": F.lit(0), "query_name": F.col("anchor")})
    # every second case has names twice, some of which no anchor speaks for
    rows = cases.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k")).select("case_id", F.concat(F.lit("s"), F.when(F.col("case_id") % 2 == 0, F.col("k") % 20).otherwise(F.col("k"))).alias("name"), F.col("k").alias("place"))
    for policy in (Policy(), Policy(hub_degree=200)):
        told = C.edges_of_rows(rows, cases, anchors, pairs, policy)
        got = scoring.all_evidence(told, policy)
        found = C.looked_up(rows.select("case_id", "name").distinct(), cases, anchors, pairs, policy)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, scoring.with_evidence(rows, found, policy).collect()))


@pytest.mark.parametrize("degree", [6, 10**9])
def test_a_run_writes_no_row_for_each_candidate(spark, monkeypatch, degree):
    """Candidates are ranked and decided where they were counted; what is kept of a run is a row for each case with its first candidates."""
    w, columns, write = _random_world(spark, 3), [], C.tabled
    monkeypatch.setattr(C, "tabled", lambda df: columns.append(df.columns) or write(df))
    done = w.propagate(hub_degree=degree)
    kept = done.kept(2)
    assert columns and not any("place" in c for c in columns) and kept.told.count() == w.cases.count()
    for rows in (lambda d: d.results, lambda d: d.top(2), lambda d: d.top(3)):
        want = rows(done)
        assert sorted(map(repr, rows(kept).select(*want.columns).collect())) == sorted(map(repr, want.collect())) != []
