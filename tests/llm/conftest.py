"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd: random.Random, n: int, kind: str = "abcdefghij") -> str:
    return " ".join("".join(rnd.choice(kind) for _ in range(rnd.randint(2, 8))) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    passage = "\n".join(sentence(rnd, 12) + "." for _ in range(5))
    rows: list[tuple] = []
    for k in range(n):
        text = "\n".join(sentence(rnd, rnd.randint(4, 14)) + "." for _ in range(rnd.randint(1, 9)))
        if k % 5 == 0:
            text += "\n" + passage + "\n" + sentence(rnd, 5) + "."
        if k % 7 == 3 and rows:
            text = rows[rnd.randrange(len(rows))][1] or "x"
        if k % 11 == 4:
            words = (rows[-1][1] or "x").split(" ")
            words[len(words) // 2] = "other"
            text = " ".join(words)
        rows.append((k * 3, text, ["en", "de", None][k % 3], ["s1", "s2", "s3", None][k % 4] if k % 3 else "s1", len(text)))
    rows.append((1000, None, "en", "s1", None))
    rows.append((1001, "", None, None, 0))
    rows.append((1002, "\n \n\t\n", "de", "", 5))
    rows.append((1003, "éà ü\n" * 40 + "ünïcode <s> [INST] ␛ end.", "fr", "s2", 200))
    rows.append((1004, sentence(rnd, 30_000), "en", "s3", 150_000))  # very long
    rows.append((1005, "a" * 900, "en", "s2", 900))
    rows.append((None, "a row without an id, of ten words or so here.", "en", "s1", 45))
    rows.append(rows[5])  # repeated
    rows.append((rows[6][0], "another text under an id that is taken.", "de", "s2", 39))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("own").alias(c) for c in ("size", "kept", "shard", "slot", "taken", "n_lines", "n_removed", "component_id", "fp", "key", "fingerprint", "target", "id")])


@pytest.fixture(scope="session")
def underscored(docs):
    """Extra columns named as operators name their own."""
    from pyspark.sql import functions as F

    names = "__id __hash __own __covered __lines __gaps __t __r __k __kt __kr __size __members __source __order __bucket __copy __taken __target __crc __n __at __range __last __row __task own0".split()
    return docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])


def table(df, *columns):
    """Sorted rows of some columns."""
    got = df.select(*(columns or df.columns)).collect()
    return sorted((tuple(r) for r in got), key=lambda r: [(x is None, str(x)) for x in r])
