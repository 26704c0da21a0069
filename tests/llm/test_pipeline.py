"""Each stage of the pipeline, and the whole, against plain versions."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from linkweave.llm import mixing, packing, quality
from tests.llm.conftest import DOCS
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_line_dedup import unique
from tests.llm.test_simhash import ordered
from tests.llm.test_similarity import brute as similarity_brute


def plain(rows):
    """The first three stages."""
    stage = []
    for d, t, lang, source, _ in rows:
        *judged, text = quality.judge_text(t, clean=True)
        if judged[-1]:
            stage.append((d, text, lang, source, len(text)))
    kept = line_brute(stage)
    after = []
    for d, t, lang, source, _ in stage:
        text, _, gone, _ = kept[d, t]
        if not gone or text.encode().split():
            after.append((d, text, lang, source, len(text)))
    stay = list(similarity_brute(after))
    return stage, after, stay


def test_stages(spark, rows, tmp_path):
    mine = unique(rows)
    docs = spark.createDataFrame(mine, DOCS)
    want = plain(mine)
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, "")
        path = str(tmp_path / str(k))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 3:
            assert docs.columns == columns
            assert ordered(map(tuple, docs.collect())) == ordered(want[k])
        elif k == 3:
            assert docs.columns == columns
            sized = spark.createDataFrame(want[2], DOCS)
            assert docs.count() == sum(r["taken"] // r["size"] for r in mixing.report(sized).collect())
            mixed = [tuple(r) for r in docs.collect()]
    tokens = {r[0]: [*packing.encoder(P.public_tokenizers.path("byte_bpe_50k.json")).encode([r[1]])[0].tolist(), 1] for r in mixed}
    got = docs.collect()
    assert sum(r["length"] for r in got) == sum(len(tokens[r[0]]) for r in mixed)
    for r in got:
        ids = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]


def test_run_is_the_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path))
    assert out.count() > 0 and P.ORACLE_SQL is None
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "empty")).count() == 0


def test_near_duplicate_stage_keeps_a_row_of_every_component(spark):
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(80)) for w in ("river", "stone", "cloud", "field"))
    rows = [(None, one), (None, one), (None, two), (None, three), (7, three), (5, two), (9, four), (9, two), (None, None), (9, "alone here"), (9, four)]
    docs = spark.createDataFrame([(d, t, "en", "s1", 1) for d, t in rows], DOCS).repartition(4)
    got = Counter((r["doc_id"], r["text"]) for r in P.simhash_stage(spark, docs, "").collect())
    assert got == Counter([(None, one), (5, two), (7, three), (9, four), (9, "alone here"), (None, None)])
