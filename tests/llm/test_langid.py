from __future__ import annotations

import random
import zlib

from linkweave.llm import langid
from tests.llm.conftest import DOCS, sentence, table

ALPHABETS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}


def rows(n=400, seed=5):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        lang = rnd.choice(list(ALPHABETS))
        out.append((k, sentence(rnd, rnd.randint(3, 60), ALPHABETS[lang]), lang, None, None))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    data += [(5000, None, "aa", None, None), (5001, "1234 !!", "aa", None, None), (5002, "", None, None, None), (5003, "abc abc", None, None, None), (None, "ijk lmn", "cc", None, None), data[0]]
    got = langid.identify(spark.createDataFrame(data, DOCS).repartition(3)).collect()
    assert len(got) == len(data)
    want = {r[0]: r[2] for r in data}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 5000]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in got if r["doc_id"] in (5000, 5001, 5002)}
    assert set(und.values()) == {("und", 0.0, True)}
    assert {r["lang_pred"] for r in got} <= {*ALPHABETS, "und"}


def test_labels_and_ids_are_no_inputs(spark):
    data = rows()
    model = langid.fit([(r[1], r[2]) for r in data[:200]])
    a = langid.predictions(spark.createDataFrame(data, DOCS), model)
    b = langid.predictions(spark.createDataFrame([(r[0] + 9, r[1], "zz", "s", 1) for r in data], DOCS), model)
    assert table(a, "lang_pred", "score") == table(b, "lang_pred", "score")


def test_scores_are_calibrated_and_strange_texts_rejected():
    data = rows(900)
    model = langid.fit([(r[1], r[2]) for r in data[:600]])
    got = [(model.predict(r[1]), r[2]) for r in data[600:]]
    right = sum(p[0] == lang for p, lang in got) / len(got)
    assert abs(sum(p[1] for p, _ in got) / len(got) - right) < 0.1
    accepted = [(p, lang) for p, lang in got if not p[2]]
    assert sum(p[0] != lang for p, lang in accepted) <= 0.05 * len(accepted)


def test_long_texts_are_read_whole():
    model = langid.fit([(r[1], r[2]) for r in rows()])
    assert model.predict("abc " * 10 + "mnop onmp " * 300_000)[0] == "cc"


def test_fit_is_repeatable_and_empty_tables(spark, nothing):
    data = [(r[1], r[2]) for r in rows(100)]
    assert (langid.fit(data).table == langid.fit(data).table).all()
    assert table(langid.identify(nothing)) == []
    none = spark.createDataFrame([(1, "abc", None, None, None), (2, None, "aa", None, None)], DOCS)
    assert table(langid.identify(none), "doc_id", "lang_pred") == [(1, "und"), (2, "und")]


def test_sample_is_bounded_and_fair(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 10)
    found = langid.sample(spark.createDataFrame(rows(), DOCS))
    learnt = {r[1] for r in rows() if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert len(found) == 30 and all(t in learnt for t, _ in found)


def plain_logits(model, text):
    """Word by word and gram by gram, without numpy's arrays."""
    total, n = [0.0] * len(model.languages), 0
    for word in text.lower().encode().translate(bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))).split(b" "):
        data = b" " + word + b" "
        for order in langid.ORDERS:
            for k in range(len(data) - order + 1):
                if b" " in data[k + 1 : k + order - 1]:
                    continue
                h = order * 2654435761 & 0xFFFFFFFF
                for c in data[k : k + order]:
                    h = (h ^ c) * 16777619 & 0xFFFFFFFF
                h ^= h >> 15
                row = model.table[h % langid.BUCKETS]
                total = [a + float(b) for a, b in zip(total, row, strict=True)]
                n += 1
    return [a / max(n, 1) + float(b) for a, b in zip(total, model.bias, strict=True)]


def test_against_plain_version(monkeypatch):
    model = langid.fit([(r[1], r[2]) for r in rows(200)])
    texts = ["abc", "a bc\td", "Héllo wörld abc", "ÀÉ ijkl mnop", "x " * 30 + "abcdefgh", " ijk  lmn ", sentence(random.Random(3), 200)]
    for piece in (1 << 20, 16):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t in texts:
            want = plain_logits(model, t)
            assert max(abs(a - b) for a, b in zip(model.logits(t), want, strict=True)) < 1e-4, t
            assert model.predict(t)[0] == model.languages[max(range(len(want)), key=lambda k: want[k])]


def test_letters_alone_count():
    model = langid.fit([(r[1], r[2]) for r in rows(100)])
    for t in ("½ ² Ⅷ ①", "१२३", "_ __", "\u0301\u0302", "12.5 €", "😀"):
        assert model.predict(t)[0] == "und", t
    for t in ("ª", "ʰ", "1 é", "字", "ا"):
        assert model.predict(t)[0] != "und", t


def test_a_language_of_long_texts_is_learnt(spark):
    data = [(k, t, lang, s, n) for k, t, lang, s, n in rows(200)] + [(1000 + k, sentence(random.Random(k), 5000, "qrstuvwx"), "dd", None, None) for k in range(20)]
    got = langid.identify(spark.createDataFrame(data, DOCS)).where("doc_id >= 1000").collect()
    assert all(r["lang_pred"] == "dd" for r in got)
