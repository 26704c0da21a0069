"""Language identification by averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are the byte n-grams (3 to 5 bytes) of its lower-cased words, with a space at each end of a word. Each is
hashed to a row of an embedding table; a text is the mean of its rows, and a linear softmax over it gives the languages.
Training: stochastic gradient descent over mini-batches of a bounded, seeded sample of labelled texts. Temperature and
rejection threshold are then set on labelled texts that training didn't see, so that score is a calibrated probability and a
prediction is rejected where the expected share of errors among those accepted would pass ERROR_RATE.

As the model is linear, embedding times softmax weights is one small table (BUCKETS x languages), which is what tasks get.

Bounds (parameters): SAMPLE texts a language and MOST_LANGUAGES languages; these texts alone reach the driver. Of the texts drawn,
those of up to TEXT_CHARS characters come first; a longer one, as where a language has no others, is learnt from by
its first TEXT_CHARS characters. Predictions read whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0; without any labelled text every prediction is `und`;
ties go to the language first in code points; repeated rows and null ids are predicted like any other row; other columns
are ignored; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.llm.common import frugal, slices

SAMPLE, TEXT_CHARS, MOST_LANGUAGES = 600, 16384, 400
BUCKETS, DIMENSIONS, ORDERS = 1 << 15, 16, (3, 4, 5)
EPOCHS, BATCH, RATE, ERROR_RATE = 8, 16, 0.5, 0.01
UND = "und"
_BREAK = re.compile(r"[\t-\r ]")
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of the text's subwords."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).copy()
    space = _SPACE[data]
    data[space] = 32
    wide = data.astype(np.uint32)
    found = []
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint32(n * 2654435761 & 0xFFFFFFFF))
        inside = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ wide[k : k + m]) * np.uint32(16777619)
            if 0 < k < n - 1:
                inside |= space[k : k + m]
        h ^= h >> np.uint32(15)
        found.append((h & np.uint32(BUCKETS - 1))[~inside])
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    languages: list[str]
    #: Embedding times softmax weights, and the softmax's bias.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        """Averages over the whole text, in pieces of PIECE characters and on to the end of a word, so that memory stays bounded and no word is cut."""
        total, n, at = np.zeros(len(self.languages)), 0, 0
        while at < len(text):
            end = _BREAK.search(text, at + PIECE)
            rows = subwords(text[at : end.start() if end else len(text)])
            counts = np.bincount(rows, minlength=BUCKETS)
            total += counts @ self.table
            n += len(rows)
            at = end.end() if end else len(text)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the prediction is rejected."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UND, 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, max(0.0, p[k]))), bool(p[k] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, language) rows; every fifth row calibrates it and isn't trained on."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    bags = []
    for text, lang in rows:
        ids, counts = np.unique(subwords(text), return_counts=True)
        bags.append((ids, (counts / max(counts.sum(), 1)).astype(np.float64), languages.index(lang)))
    held, train = bags[::5] if len(bags) >= 50 else bags, [b for k, b in enumerate(bags) if k % 5 or len(bags) < 50]
    embedding = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, total = 0, EPOCHS * -(-len(train) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for at in range(0, len(order), BATCH):
            batch = [train[k] for k in order[at : at + BATCH]]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = np.stack([w @ embedding[ids] for ids, w, _ in batch])
            wrong = softmax(hidden @ weights + bias)
            wrong[np.arange(len(batch)), [y for *_, y in batch]] -= 1
            back = wrong @ weights.T
            weights -= rate * hidden.T @ wrong / len(batch) * BATCH
            bias -= rate * wrong.mean(0)
            for (ids, w, _), g in zip(batch, back, strict=True):
                embedding[ids] -= rate * BATCH * w[:, None] * g
    model = Model(languages, embedding @ weights, bias)
    logits = np.stack([w @ model.table[ids] + bias for ids, w, _ in held])
    truth = np.array([y for *_, y in held])
    # calibration: the temperature of least log loss, then the lowest threshold whose accepted rows err rarely enough
    # (targets are smoothed by one row in all, else rows that are all right would drive the temperature to 0)
    soft = np.full(logits.shape, 1 / (len(truth) + 2) / max(1, len(languages) - 1))
    soft[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
    loss = {t: -(soft * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in np.geomspace(0.01, 10, 61)}
    model.temperature = float(min(loss, key=loss.get))
    p = softmax(logits / model.temperature)
    score, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-score)
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= ERROR_RATE)
    model.threshold = 0.9 * float(score[order[fine[-1]]]) if len(fine) else 1.0
    model.table = model.table.astype(np.float32)
    return model


def fold(doc_id: Column | str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """SAMPLE labelled texts of each language (short ones first, see above), chosen by a hash, from the folds that may be learnt from; equal texts count once.

    Counts by language give the share of each to draw; so no more than is about to be drawn is shuffled or sent."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where((fold("doc_id") != 2) & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return []
    # a fifth more, and then some, than is asked for: a hash seldom gives the exact share
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, (1.2 * SAMPLE + 50) / r[1]))])
    drawn = known.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))
    short = drawn.select(F.left("text", F.lit(TEXT_CHARS)).alias("text"), "lang", (F.length("text") > TEXT_CHARS).alias("long"), F.xxhash64("text", "doc_id").alias("h"), "doc_id")
    ranked = short.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "doc_id"))).where(F.col("k") <= SAMPLE)
    return sorted({(r[0], r[1]) for r in ranked.select("text", "lang").toLocalIterator()})


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            lang, score, rejected = zip(*map(model.predict, batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(frugal(of), "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each document, by a model of its own labelled folds."""
    found = predictions(docs, fit(sample(docs)))
    return found.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
