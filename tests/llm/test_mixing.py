from __future__ import annotations

from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.llm import mixing
from tests.llm.conftest import table


def test_targets():
    assert mixing.targets({"a": 10, "b": 10}, {"a": 1, "b": 3}, 20) == {"a": 5.0, "b": 15.0}
    assert mixing.targets({"a": 1, "b": 100, None: 100}, {"a": 100, "b": 1, None: 1}, 201) == {"a": 3.0, "b": 99.0, None: 99.0}
    assert mixing.targets({}, {}, 0) == {}
    assert mixing.targets({"a": 0, "b": 5}, {"a": 1, "b": 1}, 5) == {"a": 0.0, "b": 5.0}


def best(patterns, quotas, most):
    """Largest flow, then least repetition cost, by trying every split of tiny cases."""
    import itertools

    found = None
    names = list(patterns)
    arcs = [(p, s) for p in names for s in p]
    for amounts in itertools.product(*[range(most * patterns[p] + 1) for p, _ in arcs]):
        into, out = Counter(), Counter()
        for (p, s), a in zip(arcs, amounts, strict=True):
            out[p] += a
            into[s] += a
        if any(into[s] > quotas[s] for s in quotas) or any(out[p] > most * patterns[p] for p in names):
            continue
        cost = sum(max(0, out[p] - k * patterns[p]) for p in names for k in range(1, most))
        found = max(found, (sum(amounts), -cost)) if found else (sum(amounts), -cost)
    return found


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2), st.integers(0, 2), st.integers(0, 2), st.integers(0, 5), st.integers(0, 5))
def test_flow_is_largest_and_cheapest(a, b, ab, qa, qb):
    patterns = {("a",): a, ("b",): b, ("a", "b"): ab}
    flow = mixing.route(patterns, {"a": qa, "b": qb})
    out = {p: sum(f.values()) for p, f in flow.items()}
    assert all(0 <= x for f in flow.values() for x in f.values()) and all(out[p] <= 3 * patterns[p] for p in patterns)
    for s, q in (("a", qa), ("b", qb)):
        assert sum(f.get(s, 0) for f in flow.values()) <= q
    cost = sum(max(0, out[p] - k * patterns[p]) for p in patterns for k in (1, 2))
    assert (sum(out.values()), -cost) == best(patterns, {"a": qa, "b": qb}, 3)


def test_report(docs, rows):
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").encode().split())
    source = {(r[0], len((r[1] or "").encode().split())): r[3] for r in rows}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    aim = mixing.targets(size, {s: k % 3 + 1 for k, s in enumerate(order)}, sum(size.values()))
    for s in size:
        assert abs(taken[s] - aim[s]) <= longest[s] / 2 + 1
    assert {(r["source_size"], r["target"]) for r in got} == {(size[s], aim[s]) for s in size}


def test_reruns_agree_whatever_the_layout(docs, clashing):
    assert table(mixing.report(docs)) == table(mixing.report(clashing.repartition(2, "lang")))


def test_sql_agrees(spark, rows, docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    want = con.sql(mixing.ORACLE)
    assert sorted(want.fetchall(), key=lambda r: [(x is None, str(x)) for x in r]) == table(mixing.report(docs), *want.columns)


def test_mixed_repeats_rows(docs, nothing, clashing):
    taken = sum(r["taken"] for r in mixing.report(docs).collect())
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    assert sum(len((r["text"] or "").encode().split()) for r in out.collect()) == taken
    assert table(mixing.report(nothing)) == [] and table(mixing.mixed(nothing)) == []


def test_overlapping_sources(spark):
    rows = [(k, "w " * 10, ["a"] if k < 40 else ["b"] if k < 60 else ["b", "a"]) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    out = mixing.mix(df, mixing.words("text"), F.col("sources"), {"a": 1, "b": 1})
    assert sum(r["__taken"] * r["__size"] for r in out.collect()) == 1000
    assert Counter(r["__taken"] for r in out.collect()) == {1: 100}


def test_any_column_names(docs, underscored):
    out = mixing.mixed(underscored)
    assert out.columns == underscored.columns and table(out, *docs.columns) == table(mixing.mixed(docs))


def test_rows_under_one_id(spark):
    """A third of a source's rows share an id and a size, equal rows among them; the place lies within them."""
    rows = [(None, f"w{k % 7} x y z", "a") for k in range(400)] + [(k, "one two three four", "a") for k in range(50)] + [(k, "a b c d", "b") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for seed in range(6):
        out = mixing.mix(df, mixing.words("text"), F.array("source"), seed=str(seed)).collect()
        taken = Counter()
        for r in out:
            taken[r["source"]] += r["__size"] * r["__taken"]
        assert len(out) == len(rows) and all(abs(taken[s] - t) <= 2 for s, t in {(r["source"], r["__target"]) for r in out})
    again = mixing.mixed(df.repartition(2))
    assert table(again) == table(mixing.mixed(df)) and mixing.mixed(df).count() == 750


def test_documents_are_not_shuffled(docs):
    plan = mixing.mixed(docs.where("doc_id < 900"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source" not in plan and "SortMergeJoin" not in plan and "Window" not in plan
