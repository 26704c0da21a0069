"""Feature trees, JSON documents, the store on disk."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linkweave.operators import store
from linkweave.policy import Policy
from linkweave.sources import arrays, readers, sinks


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")

    def put(path, rows):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(json.dumps(rows))

    put("Lua_547/arm64/O0/nostrip/a/x.json", [
        {"function_name": "f", "entry_point": "1", "callees": ["g", "", None, "g", "f", "printf"], "compare": {"8": ["1"]}, "pcode_opcode_histogram": {"B": 1, "A": 1}},
        {"function_name": "g", "callees": None}, {"function_name": "", "callees": ["f"]}, {"function_name": "f", "entry_point": "2"}, {"callees": ["f"]}])
    put("Lua_547/arm64/O0/nostrip/a-b/x.json", [{"function_name": "f", "entry_point": "3", "callees": ["printf", "g"]}])
    put("Lua_547/x86_64/O2/stripped/x.json", [{"function_name": "h"}])
    put("Lua_547/x86_64/O2/x.json", [{"function_name": "too_short"}])
    put("Lua_547/x86_64/O2/neither/x.json", [{"function_name": "bad_strip"}])
    put("Lua_547/mips/O2/nostrip/x.json", [{"function_name": "bad_arch"}])
    put("Other/x86_64/O2/nostrip/x.json", [{"function_name": "bad_version"}])
    return str(root)


def test_discovery_orders_by_components(spark, tree):
    rows = readers.feature_paths(spark, tree).collect()
    assert [(r["source_json"], r["architecture"], r["strip_mode"]) for r in rows] == [
        ("Lua_547/arm64/O0/nostrip/a/x.json", "aarch64", "nostrip"), ("Lua_547/arm64/O0/nostrip/a-b/x.json", "aarch64", "nostrip"), ("Lua_547/x86_64/O2/stripped/x.json", "x86_64", "stripped"),
    ]


def test_store_is_first_wins_in_path_order(spark, tree):
    features = readers.read_features(spark, tree)
    rows = {(r["function_id"], r["graph_role"]): r["entry_point"] for r in store.functions(features).collect()}
    ref, ext = "ref::Lua_547::aarch64::O0::nostrip::", "external::Lua_547::aarch64::O0::nostrip::"
    assert rows == {(ref + "f", "reference"): "1", (ref + "g", "reference"): None, (ext + "printf", "reference_external"): None, (ext + "g", "reference_external"): None, ("ref::Lua_547::x86_64::O2::stripped::h", "reference"): None}
    got = {(r["src_name"], r["dst_id"], r["source_json"]) for r in store.edges(features).collect()}
    a, b = "Lua_547/arm64/O0/nostrip/a/x.json", "Lua_547/arm64/O0/nostrip/a-b/x.json"
    assert got == {("f", ref + "f", a), ("f", ref + "g", a), ("f", ext + "printf", a), ("f", ext + "g", b)}
    counts = {(r["architecture"], r["opt_level"]): (r["functions"], r["edges"], r["external_calls"]) for r in store.build_counts(features).collect()}
    assert counts == {("aarch64", "O0"): (4, 5, 3), ("x86_64", "O2"): (1, 0, 0)}


def test_store_round_trip_and_refusal(spark, tree, tmp_path):
    features = readers.read_features(spark, tree)
    functions, edges = store.functions(features), store.edges(features)
    path = str(tmp_path / "store")
    sinks.write_store(functions, edges, path, {"schema_version": "1"})
    got = sinks.read_store(spark, path)
    assert got[0].count() == functions.count()
    assert got[1].select("src_id", "dst_id").exceptAll(edges.select("src_id", "dst_id")).count() == 0
    with pytest.raises(FileExistsError):
        sinks.write_store(functions, edges, path)
    sinks.write_store(functions, edges, path, replace=True)
    with pytest.raises(PySparkException):  # a build that fails halfway
        sinks.write_store(functions, edges.withColumn("dst_name", F.raise_error(F.lit("broken")).cast("string")), path, replace=True)
    assert sinks.read_store(spark, path)[1].count() == edges.count() and [p.name for p in tmp_path.iterdir()] == ["store"]
    plan = got[1].where("architecture = 'x86_64' and src_name = 'f'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(architecture" in plan and "EqualTo(src_name,f)" in plan


def test_map_order_is_kept(spark, tree):
    from linkweave.functions.features import top_items

    row = readers.read_features(spark, tree).where("entry_point = '1'").select(top_items("pcode_opcode_histogram").alias("t")).collect()[0]
    assert [x["name"] for x in row["t"]] == ["B", "A"]


def test_not_an_array(spark, tmp_path):
    p = tmp_path / "Lua_5/x86_64/O0/nostrip/x.json"
    p.parent.mkdir(parents=True)
    p.write_text('{"function_name": "f"}')
    with pytest.raises(PySparkException, match="not a JSON array"):
        readers.read_features(spark, str(tmp_path)).collect()


def test_files_of_many_lines(spark, tmp_path):
    p = tmp_path / "Lua_5/x86_64/O0/nostrip/x.json"
    p.parent.mkdir(parents=True)
    p.write_text("\n " + json.dumps([{"function_name": "f", "callees": ["g"]}, {"function_name": "g"}], indent=2))
    assert [(r["row"], r["function_name"], r["callees"]) for r in readers.read_features(spark, str(tmp_path)).orderBy("row").collect()] == [(0, "f", ["g"]), (1, "g", None)]


def test_a_store_is_committed_by_its_last_rename(spark, tree, tmp_path, monkeypatch):
    features = readers.read_features(spark, tree)
    functions, edges = store.functions(features), store.edges(features)
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        sinks.read_store(spark, path)
    sinks.write_store(functions, edges, path, {"k": "first"})
    commits = tmp_path / "store" / sinks.COMMITS
    reader = sinks.read_store(spark, path)[1]

    def broken(self, at):
        if at.endswith("2"):
            commits.joinpath("000000000002").touch()  # another writer was there first
        return original(self, at)

    original = sinks._Folder.at
    monkeypatch.setattr(sinks._Folder, "at", broken)
    with pytest.raises(FileExistsError, match="meanwhile"):
        sinks.write_store(functions, edges, path, {"k": "second"}, replace=True)
    monkeypatch.setattr(sinks._Folder, "at", original)
    commits.joinpath("000000000002").unlink()
    assert [r["value"] for r in sinks.read_metadata(spark, path).collect()] == ["first"]
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("version-")]) == 1
    for k in ("third", "fourth"):
        sinks.write_store(functions, edges.limit(2), path, {"k": k}, replace=True)
        assert [r["value"] for r in sinks.read_metadata(spark, path).collect()] == [k]
        # who read the version before still can
        assert reader.count() == (edges.count() if k == "third" else 2)
        reader = sinks.read_store(spark, path)[1]
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("version-")]) == 2


def test_pairs_in_buckets_are_not_shuffled(spark, tree, tmp_path):
    from linkweave.operators import candidates as C
    from linkweave.policy import Policy

    path = str(tmp_path / "store")
    rows = [(f"f{k}", f"g{k % 7}", "calls", "reference", "Lua_547", "x86_64", o, s) for k in range(60) for o in ("O0", "O2")[: 1 + k % 2] for s in ("nostrip", "stripped")]
    edges = spark.createDataFrame(rows, "src_name string, dst_name string, edge_type string, graph_role string, lua_version string, architecture string, opt_level string, strip_mode string")
    functions = spark.createDataFrame([("f0", "Lua_547", "x86_64", "nostrip")], "function_name string, lua_version string, architecture string, strip_mode string")
    sinks.write_store(functions, edges, path)
    pairs = sinks.read_pairs(spark, path)
    want = store.pair_levels(edges)
    for side in (pairs.by_callee, pairs.by_caller):
        assert sorted(map(str, side.select(want.columns).collect())) == sorted(map(str, want.collect()))
    cases = spark.createDataFrame([(k, "Lua_547", "x86_64") for k in range(9)], "case_id long, lua_version string, architecture string")
    anchors = spark.createDataFrame([(k, r, f"{n}{k}", 0, "q") for k in range(9) for r, n in (("callee", "g"), ("caller", "f"))], "case_id long, relation string, anchor string, pos int, query_name string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.support(cases, anchors, pairs, Policy())
        plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, found.collect())) == sorted(map(str, C.support(cases, anchors, want, Policy()).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    lines = plan.split("\n")
    for k, line in enumerate(lines):
        if "FileScan parquet" in line and "linkweave_" in line:
            # upwards to the join: no exchange
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            at, above = depth(line), []
            for up in reversed(lines[:k]):
                if depth(up) < at:
                    at = depth(up)
                    above.append(up)
                    if "Join" in up:
                        break
            assert not any("Exchange" in x for x in above), plan
    assert "Bucketed: true" in plan and plan.count("FileScan parquet") >= 2


def test_tree_to_store_and_back(spark, tree, tmp_path):
    from linkweave.plans import runs

    with pytest.raises(runs.NoFiles):
        runs.build_tree(spark, str(tmp_path), str(tmp_path / "store"))
    assert not (tmp_path / "store").exists()
    path = str(tmp_path / "store")
    lines = runs.build_tree(spark, tree, path)
    assert lines[:2] == [f"[OK] wrote store: {path}", "Feature files : 3"] and lines[-1] == "  Lua_547 x86_64  O2 stripped functions=1"
    assert {r["key"]: r["value"] for r in sinks.read_metadata(spark, path).collect()} == sinks.metadata_rows(tree)
    with pytest.raises(FileExistsError):
        runs.build_tree(spark, tree, path)
    root = str(tmp_path / "again")
    rows = readers.read_features(spark, tree).select("source_json", "row", "function_name", "callees", "pcode_opcode_histogram")
    sinks.write_features(rows, root)
    again = readers.read_features(spark, root).select(*rows.columns)
    key = lambda r: (r["source_json"], r["row"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and again.count() == len({key(r) for r in rows.collect()})


def test_query_graph_in_the_store(spark, tree, tmp_path):
    graph = spark.createDataFrame([("a", "b", "calls"), ("a", "b", None), ("b", "c", "references"), ("", "c", "calls")], "src string, dst string, edge_type string")
    functions, edges = store.query_graph(graph, "Lua_547", "x86_64", "O0", "nostrip", "q.json")
    features = readers.read_features(spark, tree)
    sinks.write_store(store.functions(features).unionByName(functions), store.edges(features).unionByName(edges), str(tmp_path / "s"))
    f, e = sinks.read_store(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in store.stored_query_edges(e).collect()} == {("a", "b", "calls"), ("b", "c", "references")}
    assert store.reference_names(f).count() == store.reference_names(store.functions(features)).count()
    assert {(r["src"], r["dst"]) for r in store.query_adjacency(store.stored_query_edges(e)).collect()} == {("a", "b")}
    typed = e.withColumn("edge_type", F.when(F.col("dst_name") == "g", "references").otherwise("calls"))
    assert {r["dst_name"] for r in store.pair_levels(typed).collect()} == {"f", "printf"}
    assert {r["dst_name"] for r in store.pair_levels(typed, edge_types=("calls", "references")).collect()} == {"f", "g", "printf"}


def test_no_folder_of_its_own_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from linkweave import checkpoints

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoints.shared(session)


def test_expected_items(spark):
    assert {(r[0], r[1]) for r in readers.parse_expected(spark, ["a=b", "a=c=d"]).collect()} == {("a", "c=d")}
    with pytest.raises(ValueError):
        readers.parse_expected(spark, ["ab"])
    assert readers.resolve_path("x", "/r") == "/r/x" and readers.resolve_path("/x", "/r") == "/x"


def test_suite_and_cases(spark, tree, tmp_path):
    suite, cases = tmp_path / "suite.json", tmp_path / "cases.json"
    suite.write_text(json.dumps({"suite_name": "s", "output_top_candidates": 3, "anchor_policy": {"exclude_prefixes": ["lua_"]}, "classification_policy": {"accept_margin": 0.02}, "cases": [{"case_id": "1", "expected_function": "f"}]}))
    listed = [{"function_name": "a", "score_total": 0.5}, {"function_name": None}]
    one = {"case_id": "1", "mode": "m", "query_file": "Lua_547/arm64/O0/nostrip/a/x.json", "query_func": "f", "unique_topk_preview": listed}
    cases.write_text(json.dumps({"cases": [{**one, "mode": "old"}, one, {**one, "case_id": "2", "query_func": "absent"}]}))
    policy, found = readers.read_suite(spark, str(suite), expansion_limit=7)
    assert (policy.output_top_candidates, policy.exclude_prefixes, policy.accept_margin, policy.expansion_limit, policy.primary_opt) == (3, ("lua_",), 0.02, 7, "O0")
    rows, candidates = readers.read_cases(spark, str(cases))
    features = readers.read_features(spark, tree)
    bound, neighbours = readers.bind_cases(found, rows, features, policy)
    row = bound.collect()[0]
    assert (row["mode"], row["architecture"], row["lua_version"], row["expected_function"]) == ("m", "x86_64", "Lua_547", "f")
    assert [r["name"] for r in neighbours.where("relation = 'callee'").orderBy("pos").collect()] == ["g", "", None, "g", "f", "printf"]
    assert candidates.where("case_id = '1'").count() == 2
    absent = spark.createDataFrame([(0, "2", None), (1, "9", None)], "suite_pos int, case_id string, expected_function string")
    with pytest.raises(PySparkException, match="no retrieval case or feature row"):
        readers.bind_cases(absent, rows, features, policy)[0].collect()


def test_documents_keep_characters(spark, tmp_path):
    sinks.write_documents(spark.createDataFrame([("é→", None)], "a string, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[0][0] == '{"a":"é→","b":null}'
    assert sinks.summary_lines(spark.createDataFrame([(1, 2)], "x int, y int")) == ["x: 1", "y: 2"]
    assert Policy().primary_bonus == 0.04


def test_a_document_is_joined_in_order(spark, tmp_path):
    import json

    from linkweave.plans import documents

    rows = spark.range(500).repartition(7).select(F.concat(F.lit("c"), F.lpad(((F.col("id") * 7) % 400).cast("string"), 4, "0")).alias("case_id"), "id", F.lit("é \n\"").alias("text"))
    one = spark.createDataFrame([(3, "x")], "n int, of string")
    none = rows.where("id < 0")
    path = str(tmp_path / "deep" / "run.json")
    lines = documents.document({"name": F.lit(None).cast("string"), "n": F.lit(1)}, {"summary": one}, {"results": rows, "others": none, "again": rows.limit(1)})
    assert lines.rdd.getNumPartitions() > 1
    sinks.write_document(lines, path)
    got = json.loads((tmp_path / "deep" / "run.json").read_text(encoding="utf-8"))
    assert list(got) == ["schema_version", "name", "n", "summary", "results", "others", "again"]
    assert got["summary"] == {"n": 3, "of": "x"} and got["name"] is None and got["others"] == [] and len(got["again"]) == 1
    assert [r["case_id"] for r in got["results"]] == sorted(r["case_id"] for r in rows.collect()) and {r["text"] for r in got["results"]} == {"é \n\""}
    with pytest.raises(FileExistsError):
        sinks.write_document(lines, path)
    sinks.write_document(documents.document({}, {"summary": one}, {}), path, replace=True)
    assert json.loads((tmp_path / "deep" / "run.json").read_text()) == {"schema_version": "0.1", "summary": {"n": 3, "of": "x"}}
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == ["run.json"]


def test_anchor_stream(spark, tmp_path):
    from linkweave.streaming import append_anchors

    rows = spark.createDataFrame([("a", "accepted"), ("b", "deferred")], "query_function_name string, status string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        append_anchors(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


ODD = ['}', '{"', "\\", '\\"}', "}, {", "[1, 2]", "é 東\n\t", '"', "", "],[", "a\\\\", ':"{']


def _odd_rows(n):
    """Rows whose strings hold what looks like the ends of rows, some of them longer than a range."""
    return [{"function_name": f"f{k}" + ODD[k % 12], "entry_point": ODD[k * 5 % 12] * (400 if k % 50 == 7 else 1), "callees": [ODD[(k + j) % 12] for j in range(k % 4)],
             "compare": {ODD[k % 11]: ["x", "}"], "n": []}, "pcode_opcode_histogram": {"a}": k, '"': 2} if k % 3 else {}, "more": {"deep": [{"er": "}"}, []]}} for k in range(n)]


@pytest.fixture
def narrow(spark):
    """Ranges of 4 KB."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_arrays_are_read_by_many_tasks(spark, tmp_path, narrow):
    p = tmp_path / "Lua_5/x86_64/O0/nostrip/x.json"
    p.parent.mkdir(parents=True)
    texts = {"x": json.dumps(_odd_rows(400)), "lines": "﻿ \r\n" + json.dumps(_odd_rows(150), indent=2, ensure_ascii=False) + " \n", "empty": " [ \n] ", "one": '[{"function_name": "}"}]', "tight": json.dumps(_odd_rows(60), separators=(",", ":"))}
    for name, text in texts.items():
        p.with_name(f"{name}.json").write_text(text, encoding="utf-8")
    assert arrays.pieces(spark, str(tmp_path), 0).where("path LIKE '%/x.json'").select("block").distinct().count() > 10
    want = readers.read_features(spark, str(tmp_path))
    order = ["source_json", "row"]
    rows = [r.asDict() for r in want.orderBy(*order).collect()]
    assert len(rows) == 611
    for whole in (0, 30_000):  # all files, and the larger ones alone
        assert [r.asDict() for r in readers.read_features(spark, str(tmp_path), whole).orderBy(*order).collect()] == rows
    x = [r for r in rows if r["source_json"].endswith("/x.json")]
    assert [(r["function_name"], r["callees"]) for r in x] == [(r["function_name"], r["callees"]) for r in _odd_rows(400)]


@pytest.mark.parametrize("text", ['{"function_name": "f"}', '[{"function_name": "f"}', '[{"function_name": "f"}, {"fun', '[{"function_name": "f"} {"function_name": "g"}]', '[{"function_name": "f"}, 3]', '[{"function_name": "f"}] x', "[1]", " x "])
def test_files_that_are_no_arrays(spark, tmp_path, text):
    p = tmp_path / "Lua_5/x86_64/O0/nostrip/x.json"
    p.parent.mkdir(parents=True)
    p.write_text(text, encoding="utf-8")
    with pytest.raises(PySparkException, match="not a JSON array"):
        readers.read_features(spark, str(tmp_path), 0).collect()


def test_a_tree_is_read_once_for_its_store(spark, tree):
    from linkweave.plans import runs

    features = readers.read_features(spark, tree)
    built = runs.build_store(features)
    for df, want in zip(built, (store.functions(features), store.edges(features), store.build_counts(features)), strict=True):
        assert "from_json" in want._jdf.queryExecution().toString() and "from_json" not in df._jdf.queryExecution().toString()
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))


def test_texts_of_a_large_document_are_dealt_out_by_range_once(spark, tmp_path, narrow):
    (tmp_path / "d.json").write_text(json.dumps({"edges": [{"src": f"a{k}", "dst": 'b["]'[: k % 5], "edge_type": "calls"} for k in range(900)]}), encoding="utf-8")
    pieces = arrays.document_pieces(spark, f"{tmp_path}/d.json")
    assert pieces.select("block").distinct().count() > 5
    plan = arrays._stretches(pieces, 2)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan  # no checkpoint, which holds texts as they are
    rows = readers.Document(spark, f"{tmp_path}/d.json", 0).entries("edges", "struct<src:string,dst:string>").orderBy("pos").select("pos", "e.src", "e.dst").collect()
    assert [tuple(r) for r in rows] == [(k, f"a{k}", 'b["]'[: k % 5]) for k in range(900)]
