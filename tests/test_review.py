"""Review records, prompts and answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from linkweave.functions import features as FF
from linkweave.functions.names import name_summary, role_hint
from linkweave.operators import analyst, review
from linkweave.plans.runs import review_run
from linkweave.policy import Policy
from linkweave.sources.schemas import FEATURES
from tests.test_propagation import World


def one(spark, column, schema="a int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("x")).collect()[0]["x"]


def test_role_hints(spark):
    want = {"luaL_len": "luaL_ prefix", "lua_type": "lua_ prefix", "luaV_x": "luaV_ prefix", "luaD_x": "luaD_ prefix", "luaU_x": "luaU_ prefix", "luaX_x": "lexer-related name", "llex": "lexer-related name", "llexx": "no public Lua API prefix", "luaC_x": "luaC_ prefix", "": "missing candidate name", None: "missing candidate name"}
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", role_hint("n").alias("r")).collect()
    assert {r["n"]: r["r"]["rationale"] for r in rows} == want


def test_name_summary(spark):
    names = ["a", "", None, "FUN_1", "FUNC_2", "sub_3", "b"]
    assert tuple(one(spark, name_summary("n", 1), "n array<string>", (names,))) == (7, 2, 5, ["a"])
    assert tuple(one(spark, name_summary("n"), "n array<string>", (None,))) == (0, 0, 0, [])


def test_golden_tags(spark):
    schema = "s array<string>, callees array<string>, callers array<string>, n int, b int"
    tags = FF.feature_tags("s", "callees", "callers", "n", "b")
    small = ([], ["x"], ["f"] + ["FUN_1"] * 19, 71, 3)
    assert one(spark, tags, schema, small) == ["small_api_wrapper_like_function", "no_strings", "few_visible_callers"]
    loader = (["truncated chunk"] + ["s"] * 9, ["c"] * 11, ["f"], 835, 58)
    assert one(spark, tags, schema, loader) == ["string_rich", "binary_chunk_or_loader_related_strings", "large_complex_function", "call_heavy", "few_visible_callers"]
    assert one(spark, tags, schema, (None, None, None, None, None)) == ["small_api_wrapper_like_function", "no_strings", "few_visible_callers"]


def test_golden_compare_and_histogram(spark):
    sample = one(spark, FF.compare_sample("m"), "m map<string,array<string>>", ({"433": ["1"] * 7, "93": ["2", "3"]},))
    assert sample["offset_count"] == 2
    assert [(x["offset"], x["value"]) for x in sample["sample"]] == [("433", "1")] * 7 + [("93", "2")]
    read = F.from_json("t", "map<string,int>")  # as from a file: a dict would lose its order on the way
    top = one(spark, FF.top_items(read, 3), "t string", ('{"Z": 1, "B": 5, "A": 1, "C": 1}',))
    assert [(x["name"], x["count"]) for x in top] == [("B", 5), ("Z", 1), ("A", 1)]


def test_categories(spark):
    rows = [(["low_score_margin", "no_anchor_evidence"], "ambiguous_candidate_tie"), (["no_anchor_evidence", "insufficient_primary_graph_matches"], "needs_more_graph_anchors"), (["duplicate_accepted_mapping_in_query_scope"], "mapping_conflict"), (["no_candidates"], "manual_review"), ([], "manual_review")]
    got = spark.createDataFrame(rows, "r array<string>, want string").select(review.category("r").alias("c"), "want", review.action(review.category("r")).alias("a")).collect()
    assert all(r["c"] == r["want"] and r["a"] == review.ACTIONS[r["c"]] for r in got)
    described = one(spark, review.described(F.array(F.lit("no_candidates"), F.lit("other"))))
    assert [x["description"] for x in described] == [review.REASONS["no_candidates"], review.UNKNOWN_REASON]


def test_records_and_prompts(spark):
    w = World(spark, [("x", "a", "O0"), ("y", "a", "O0")], [("1", "callee", 0, "a"), ("2", "callee", 0, "?")], [("1", 0, "x", 0.65), ("2", 0, "luaU_undump", 0.765263)], [("a", "a")], {"1": "x"})
    feature = {"function_name": "?1", "architecture": "arm64", "callees": ["a"], "pcode_opcode_histogram": {f"O{k:02}": 1 for k in range(12)}, "strings": [str(k) for k in range(30)]}
    rows = spark.createDataFrame([feature], FEATURES).withColumns({"query_file": F.lit("f"), "query_func": F.lit("?1")})
    records, summary, counts = review_run(w.propagate(), rows, Policy())
    got = {r["case_id"]: r for r in records.collect()}
    assert got["1"]["query_feature_summary"]["architecture"] == "arm64" and got["2"]["query_feature_summary"] is None
    assert got["1"]["query_feature_summary"]["string_count"] == 30 and len(got["1"]["query_feature_summary"]["strings"]) == 20
    assert got["2"]["score_margin_top1_top2"] is None and got["2"]["review_category"] == "needs_more_graph_anchors"
    assert got["2"]["top_candidates"][0]["role_hint"]["rationale"] == "luaU_ prefix"
    assert tuple(summary.collect()[0]) == (2, 0, 1)
    assert {r[0]: r[1] for r in counts.collect()} == {"ambiguous_candidate_tie": 1, "needs_more_graph_anchors": 1}
    asked = analyst.prompts(records)
    prompt = {r["case_id"]: json.loads(r["prompt"].split("Case:\n", 1)[1]) for r in asked.collect()}
    assert len(prompt["1"]["llm_payload"]["query_feature_summary"]["strings"]) == 12
    assert len(prompt["1"]["llm_payload"]["query_feature_summary"]["top_pcode_opcodes"]) == 8
    assert prompt["2"]["llm_payload"]["query_feature_summary"]["strings"] == [] and prompt["2"]["llm_payload"]["query_feature_summary"]["architecture"] is None
    assert [tuple(x) for x in got["1"]["anchors"]["callees"]] == [("a", "a", "seed_anchor")] and got["2"]["anchors"]["callees"] == []
    assert analyst.ordered(asked, 1).count() == 1
    dry = analyst.dry_run(asked)
    assert tuple(analyst.run_summary(dry).collect()[0]) == (0, 2, 0)
    assert [r["review_priority"] for r in review.human_report(records).collect()] == [2, 3]


def test_answers(spark):
    texts = {'\n\n {"a": 1}\n': {"a": 1}, 'Sure: {"a": {"b": 2}} ok': {"a": {"b": 2}}, "none": None, "}{": None, "": None, "{cut": None, "[1, 2]": [1, 2], None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", analyst.parsed("t").alias("j")).collect()
    assert {r["t"]: r["j"] and json.loads(r["j"]) for r in rows} == texts


def test_calls_that_fail_are_rows(spark):
    asked = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "odd")], "case_id string, prompt string")

    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("HTTP 500: no")
        return '{"x": 1}' if prompt == "good" else "words"

    got = {r["case_id"]: r for r in analyst.ask(asked, client, "test", "m").collect()}
    assert (got["1"]["status"], got["1"]["analysis"], got["1"]["prompt"]) == ("completed", '{"x":1}', None)
    assert (got["2"]["status"], got["2"]["error"], got["2"]["prompt"]) == ("error", "HTTP 500: no", "bad")
    assert (got["3"]["status"], got["3"]["analysis"]) == ("completed", None)


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    asked = spark.createDataFrame([(k, f"p{k % 30}") for k in range(40)], "case_id long, prompt string").repartition(3)
    calls = str(tmp_path / "calls")

    def client(prompt):
        import os
        import uuid

        os.makedirs(f"{calls}/{prompt}", exist_ok=True)
        n = len(os.listdir(f"{calls}/{prompt}"))
        open(f"{calls}/{prompt}/{uuid.uuid4().hex}", "w").close()
        if len(os.listdir(calls)) > 14 and not os.path.exists(f"{calls}-stopped"):
            open(f"{calls}-stopped", "w").close()
            raise AttributeError("stopped")  # nothing that a call raises: the run ends here
        if prompt in ("p3", "p4") and n < 2:
            raise RuntimeError("busy")
        if prompt == "p5":
            raise RuntimeError("never")
        return json.dumps({"p": prompt})

    path = str(tmp_path / "answers")
    with pytest.raises(Exception, match="stopped"):
        analyst.ask_and_keep(asked, client, "test", "m", path, waves=6, delay=0.0)
    kept = {r["raw_response"] for r in spark.read.parquet(path).where("status = 'completed'").collect()}
    before = {p.name: len(list(p.iterdir())) for p in (tmp_path / "calls").iterdir()}
    got = {r["case_id"]: r for r in analyst.ask_and_keep(asked, client, "test", "m", path, waves=6, delay=0.0).collect()}
    assert sorted(got) == list(range(40))
    assert all(json.loads(r["analysis"]) == {"p": f"p{k % 30}"} for k, r in got.items() if k % 30 != 5)
    assert (got[5]["status"], got[5]["error"], got[35]["prompt"]) == ("error", "never", "p5")
    after = {p.name: len(list(p.iterdir())) for p in (tmp_path / "calls").iterdir()}
    done = {json.loads(r)["p"] for r in kept}
    assert done and all(after[p] == before[p] for p in done)
    assert after["p3"] >= 3 and all(n == 1 for p, n in after.items() if p not in before and p not in ("p3", "p4", "p5"))


def test_http_client(monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    import pytest

    from linkweave.sources import http

    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            fine = body.get("model") != "broken"
            self.send_response(200 if fine else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"response": "r", "choices": [{"message": {"content": "c"}}]}).encode() if fine else b"no")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert http.ollama("m", url)("p") == "r" and http.chat_completions("m", url, 0.0, json_only=True)("p") == "c"
    assert seen[0][1]["options"] == {"temperature": 0.1} and seen[1][1]["response_format"] == {"type": "json_object"}
    with pytest.raises(RuntimeError, match="HTTP 500: no"):
        http.ollama("broken", url)("p")
    assert [s[0] for s in seen[:2]] == ["/api/generate", "/chat/completions"] and seen[1][2] is None
    monkeypatch.setenv(http.KEY_VARIABLE, "k")
    http.chat_completions("m", url)("p")
    assert seen[-1][2] == "Bearer k"
    server.shutdown()
