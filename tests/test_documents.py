"""Documents whose arrays are read by many tasks."""

from __future__ import annotations

import json
import re

from linkweave.sources import readers, sinks

HEADER = "name string, summary struct<note:string,inner:struct<a:int>,cases:array<struct<id:bigint>>>, tail int"
ENTRY = "struct<id:bigint,text:string,cases:array<struct<id:bigint>>>"


def test_a_large_document_is_read_as_a_small_one(spark, tmp_path):
    odd = ['}, {"', '"cases": [ {', "\\", '\\"', "]}", "\n", "é"]
    entry = lambda k: {"id": k, "text": odd[k % len(odd)] * (k % 3), "cases": [{"id": k}] * (k % 3)}
    whole = {
        "name": 'a "cases": [ { b', "prefixes": ["P1", "{"], "by": {"x": {"n": 1}, "cases": [{"id": -1}], "y": {"n": 2}}, "cases": [entry(k) for k in range(300)], "none": [], "other": [{"id": 7, "text": "o", "cases": []}, {"id": 8, "text": None, "cases": None}],
        "summary": {"note": "}]", "inner": {"a": 3}, "cases": [{"id": 5}]}, "tail": 4,
    }
    for k, text in enumerate((json.dumps(whole), json.dumps(whole, indent=2, ensure_ascii=False) + "\n")):
        path = f"{tmp_path}/d{k}.json"
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            many, one = readers.Document(spark, path, 0), readers.Document(spark, path)
            assert many._split and not one._split
            assert many.header(HEADER).collect() == one.header(HEADER).collect()
            for field in ("cases", "other", "none", "absent"):
                got = sorted(map(tuple, many.entries(field, ENTRY).collect()))
                assert got == sorted(map(tuple, one.entries(field, ENTRY).collect()))
                assert len(got) == len(whole.get(field, []))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_large_feature_file_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('Lua_547/x86_64/O0/nostrip/', id % 2, '.json') AS source_json", "499 - id AS row", "concat('f', id) AS function_name", "repeat('x', 2000) AS entry_point")
    rows = rows.unionByName(rows.where("row = 0"))  # a row twice
    held = []
    whole, sinks._joined = sinks._joined, lambda spark, folder, parts, out: (held.append(len(parts)), whole(spark, folder, parts, out))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_features(rows, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sinks._joined = whole
    assert max(held) > 1
    for k in (0, 1):
        with open(f"{tmp_path}/t/Lua_547/x86_64/O0/nostrip/{k}.json", encoding="utf-8") as f:
            got = [r["function_name"] for r in json.load(f)]
        assert got == ["f499"] * (k == 1) + [f"f{i}" for i in range(499, -1, -1) if i % 2 == k]


def test_records_of_a_document_are_kept_as_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from linkweave.plans import documents

    rows = spark.range(200).select((F.col("id") % 20).alias("case_id"), F.array(F.col("id")).alias("x")).unionByName(spark.createDataFrame([(None, [7])], "case_id long, x array<long>"))
    lines = documents.document({"n": F.lit(1)}, {}, {"a": rows, "b": rows.where("case_id = 3")})
    # text is made behind the shuffle
    behind, _, ahead = lines._jdf.queryExecution().analyzed().toString().partition("RepartitionByExpression")
    told = r"to_json\([^#]*record\d#"
    assert re.search(told, behind) and not re.search(told, ahead)
    sinks.write_document(lines, f"{tmp_path}/d.json")
    with open(f"{tmp_path}/d.json", encoding="utf-8") as f:
        got = json.load(f)
    assert [r["case_id"] for r in got["a"]] == [None, *sorted(k % 20 for k in range(200))]
    assert sorted(r["x"][0] for r in got["a"] if r["case_id"] is not None) == list(range(200)) and len(got["b"]) == 10
