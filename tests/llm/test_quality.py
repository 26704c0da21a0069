from __future__ import annotations

import re

import duckdb

from linkweave.llm import quality
from tests.llm.conftest import table

CLEAN = "A plain line of ordinary words that ends with a stop.\nAnother one follows it here, and it is fine too."


def verdict(text):
    return dict(zip(re.findall(r"(\w+) \w+", quality.JUDGED), quality.judge_text(text), strict=True))


def test_base_columns():
    got = verdict("one two three four five six\none two three four five six\n\n# $ | <b>")
    assert (got["n_words"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"], got["word_chars"]) == (16, 5, 1, 12, 2 * 22 + 6)
    assert got["base_failed"] and not got["kept"]
    assert verdict(None) == verdict("") and verdict("")["base_failed"]
    assert verdict("\u00e9\u00a0\u00e0\x0b b")["n_words"] == 2  # U+00A0 is part of a word


def test_repeated_words_against_plain_version():
    import random

    rnd = random.Random(4)
    for _ in range(200):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 40))]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
        assert quality.repeated_words(words) == len(covered)


def test_line_rules():
    bad = ["Home | News | Sport | More", "THIS!! IS!! ALL!! SHOUTED!! HERE!! NOW!!", "wor### with$$$ many&&& signs%%% here###", " ".join(["same"] * 30), "All rights reserved.", " ".join(f"w{k}" for k in range(12))]
    for line in bad:
        words = line.encode().split()
        assert quality.line_fails(line.encode(), words) or quality.unclosed([words])[0], line
        assert verdict(CLEAN + "\n" + line)["n_bad_lines"] == 1
    assert verdict(CLEAN)["kept"] and verdict(CLEAN)["n_bad_lines"] == 0
    assert not verdict(CLEAN[:54] + "\n" + "\n".join(f"Home{k} | News | Sport | More of it | x | y | z | w | v" for k in range(5)))["kept"]


WRAPPED = {
    "en": "the river runs past the old mill and turns again to\nthe north where the hills begin and no road was ever\nbuilt because nobody lived there in the years before the war\nand few have come since then.",
    "de": "der alte mann ging jeden morgen am fluss entlang bis zu\nder bank unter den linden wo er auf die zeitung wartete und\nmit den nachbarn über das wetter sprach das sich nie so\nrecht entscheiden wollte.",
    "es": "la casa de la colina estaba vacía desde hacía muchos años y\nlos niños del pueblo contaban que por las noches se oían voces\nque nadie conocía y que hablaban de un tesoro escondido bajo la\npiedra grande del jardín.",
    "fr": "la vieille horloge du village ne sonnait plus depuis que le maire\navait décidé de la faire réparer par un artisan qui ne venait\njamais et dont personne ne savait plus le nom ni la rue\noù il avait vécu autrefois.",
}


def test_wrapped_prose_stays():
    for text in WRAPPED.values():
        got = verdict(text)
        assert got["kept"] and got["n_bad_lines"] == 0
        assert verdict(text + "\n\n" + text.replace(".", "").upper())["n_bad_lines"] > 0
    loose = "\n".join(f"a{k} list of words that goes on without any end at all" for k in range(20))
    assert verdict(loose)["n_bad_lines"] == 20 and verdict(loose + "\nand stops.")["n_bad_lines"] == 20
    assert verdict(loose[: loose.index("a3")] + "and stops here at last, so it is a sentence.")["n_bad_lines"] == 0


def test_sentences_of_other_scripts_stay():
    for text in ("यह एक वाक्य है जो दस से अधिक शब्दों का बना है।", "هل هذه جملة طويلة من أكثر من عشر كلمات في سطر واحد هنا؟", "这 是 一 个 句 子 它 有 十 个 以 上 的 词。", "これ は 十 語 より 長い 文 で あり 終わり が ある！", "Սա մի նախադասություն է որը ունի տասից ավելի բառեր մեկ տողում հիմա։"):
        assert verdict(text)["kept"], text
        assert not verdict(text[:-1])["kept"], text


def test_furniture_in_each_language():
    for line in ("Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Tous droits réservés.", "POLITIQUE DE CONFIDENTIALITÉ"):
        assert verdict(CLEAN + "\n" + line)["n_bad_lines"] == 1


def test_tables(spark, docs, rows, nothing, clashing):
    got = table(quality.judge(docs), "doc_id", "n_words", "kept")
    assert got == sorted([(r[0], len((r[1] or "").encode().split()), quality.judge_text(r[1])[-1]) for r in rows], key=lambda r: [(x is None, str(x)) for x in r])
    assert table(quality.judge(nothing)) == [] and quality.clean(nothing).columns == nothing.columns
    assert table(quality.judge(clashing)) == table(quality.judge(docs))
    cleaned = quality.clean(clashing)
    assert cleaned.columns == clashing.columns and cleaned.count() == sum(quality.judge_text(r[1])[-1] for r in rows)


def test_clean_removes_failing_lines(spark):
    text = CLEAN + "\nHome | News | Sport | More\n\nLast line of the text, with a stop at its end."
    out = quality.clean(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")).collect()
    assert [(r["text"], r["n_chars"]) for r in out] == [(text.replace("\nHome | News | Sport | More", ""), len(text) - 27)]


def test_sql_agrees(spark, docs):
    con = duckdb.connect()
    more = [(5000 + k, x, None, None, 1) for k, t in enumerate(WRAPPED.values()) for x in (t, t + "\n\n" + t[:-1] + "\nx", t.replace(".", ""), "Home\n" + t + "\n" + t.replace(".", "\"") + "\n\nTous droits réservés\n" * 3)]
    more.append((6000, "\n".join(f"a{k} list of words that goes on without any end at all" for k in range(12)) + "\nand stops.", None, None, 1))
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con.register("documents", documents)
    want = con.sql(quality.ORACLE)
    key = lambda r: [(x is None, str(x)) for x in r]
    rows = [tuple(None if x != x else x for x in r) for r in want.fetchall()]
    assert sorted(rows, key=key) == table(quality.judge(docs), *want.columns)
