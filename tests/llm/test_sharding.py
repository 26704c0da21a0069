from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkweave.llm import sharding
from tests.llm.conftest import table


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_walked_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.walked(F.col("id"), n, "s").alias("y")).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert got != sorted(got) and got != [r[0] for r in spark.range(n).select(sharding.walked(F.col("id"), n, "t")).collect()]


def check(got, rows, shards=40):
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by: dict[int, list[int]] = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(k, [])) for k in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1


def test_law_rows(docs, rows):
    got = sharding.shard_documents(docs).collect()
    check(got, rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_layout_and_extra_columns_change_nothing(docs, clashing):
    assert table(sharding.shard_documents(docs)) == table(sharding.shard_documents(clashing.repartition(3, "n_chars")))


def test_hot_row_and_empty(spark, nothing):
    rows = [(7, "same", None, None, None)] * 500 + [(None, None, None, None, None)] * 300 + [(k, "x", None, None, None) for k in range(50)]
    check(sharding.shard_documents(spark.createDataFrame(rows, nothing.schema)).collect(), rows)
    assert table(sharding.shard_documents(nothing)) == []


def test_shuffled_keeps_rows(docs, rows):
    out = sharding.shuffled(docs, 4)
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(rows)
    assert len({(r["shard"], r["slot"]) for r in out.collect()}) == len(rows)


def test_no_python_in_the_plan(docs):
    plan = sharding.shard_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "SinglePartition" not in plan


def test_hot_rows_are_spread_in_ranges(spark, nothing, monkeypatch):
    from linkweave.llm import common

    monkeypatch.setattr(common, "SPREAD", 64)
    rows = [(7, "same", None, None, None)] * 1000 + [(k, "x", None, None, None) for k in range(50)]
    check(sharding.shard_documents(spark.createDataFrame(rows, nothing.schema)).collect(), rows)


def test_any_column_names(docs, underscored):
    out = sharding.shuffled(underscored.withColumn("shard", F.lit("mine")), 4)
    assert out.columns == [*underscored.columns, "shard", "slot"] and table(out, *docs.columns) == table(docs)


def test_columns_without_a_hash_and_copies_of_one_row(spark):
    """Maps have no hash; 3,000 copies of a row are dealt out like other rows."""
    import corpus_pipeline as P
    from linkweave.llm import mixing

    rows = [(7, "same text here", "en", "s1", 14, {"a": 1})] * 3000 + [(100 + k, f"text {k} of it", "en", "s2", 9, {"b": k}) for k in range(40)] + [(7, "same text here", "en", "s1", 14, {"a": 2}), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more map<string,int>").repartition(5)
    out = sharding.shuffled(docs, 6).collect()
    assert Counter((r.doc_id, r.text, str(r.more)) for r in out) == Counter((r[0], r[1], str(r[5])) for r in rows)
    for k in range(6):
        slots = sorted(r.slot for r in out if r.shard == k)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 6) < 1
    assert Counter(r.doc_id for r in P.simhash_stage(spark, docs, "").collect())[7] == 1
    assert {r.doc_id for r in mixing.mixed(docs).collect()} >= {7}
