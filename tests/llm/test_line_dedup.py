from __future__ import annotations

import hashlib

import duckdb
import xxhash  # noqa: F401

from linkweave.llm import line_dedup
from tests.llm.conftest import table


def brute(rows):
    """(id, text) to kept text and counts; rows that agree in both are one document."""
    seen, out = set(), {}
    for d, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not "".join(w).encode().split():
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        spans = sum(k - 1 not in gone for k in gone)
        out[d, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone), spans)
    return out


def unique(rows):
    """Ids that two texts share have no order that the plain version knows."""
    return [r for r in rows if len({x[1] for x in rows if x[0] == r[0]}) == 1]


def test_against_plain_version(spark, rows, docs):
    mine = unique(rows)
    want = brute(mine)
    got = line_dedup.report(spark.createDataFrame(mine, docs.schema)).collect()
    assert len(got) == len(mine)
    for r in got:
        text = next(x[1] for x in mine if x[0] == r["doc_id"])
        kept, n, gone, spans = want[r["doc_id"], text] if text is not None else ("", 0, 0, 0)
        assert (r["n_lines"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept_chars"]) == (n, gone, spans, hashlib.sha256(kept.encode()).hexdigest(), len(kept))
    assert any(r["n_removed"] for r in got)


def test_overlaps_and_self_repeats(spark):
    rows = [(1, "a\nb\nc\na\nb\nc\na\nb\nc"), (2, "x\na\nb\nc\ny"), (3, "\n\n\n\n\n\n"), (4, "a\nb"), (5, None)]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_spans"]) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("a\nb\nc", 6, 1), 2: ("x\ny", 3, 1), 3: ("\n\n\n\n\n\n", 0, 0), 4: ("a\nb", 0, 0), 5: (None, 0, 0)}


def test_clean_keeps_columns_and_drops_emptied(spark, docs, nothing, clashing):
    out = line_dedup.clean(clashing)
    assert out.columns == clashing.columns and {r["n_lines"] for r in out.collect()} == {"own"}
    plain = line_dedup.clean(docs)
    assert table(plain) == table(out.select(*docs.columns))
    emptied = [r for r in line_dedup.deduplicated(docs).collect() if r["n_removed"] and not (r["text"] or "").encode().split()]
    assert emptied and plain.count() == docs.count() - len(emptied)
    assert table(line_dedup.report(nothing)) == [] and table(line_dedup.clean(nothing)) == []


def test_sql_agrees(spark, rows, docs):
    con = duckdb.connect()
    mine = unique(rows)
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in mine if r[0] is not None])
    want = con.sql(line_dedup.ORACLE)
    got = table(line_dedup.report(spark.createDataFrame([r for r in mine if r[0] is not None], docs.schema)), *want.columns)
    assert sorted(set(want.fetchall()), key=lambda r: [(x is None, str(x)) for x in r]) == sorted(set(got), key=lambda r: [(x is None, str(x)) for x in r])


def test_no_python_in_the_plan(docs):
    plan = line_dedup.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan


def test_any_column_names(docs, underscored):
    for run in (line_dedup.clean, line_dedup.deduplicated):
        out, plain = run(underscored), run(docs)
        assert table(out, *plain.columns) == table(plain)
        assert set(underscored.columns) <= set(out.columns)
        assert all(r["__hash"] == (f"__hash{r['doc_id']}" if r["doc_id"] is not None else None) for r in out.collect())
