"""Line-first quality rules: lines are judged one by one, failing ones go, and documents that lose too much text are rejected.

A line with a word fails if one of these holds (shares of its characters are of those in words):
  navigation   3 or more words and over a quarter of them are separators such as | or >
  symbols      over a tenth of the characters are of #*$%&|<>
  shouting     5 or more words, over half of the letters' words are upper case throughout
  repeating    20 or more words, under a fifth of them different
  boilerplate  it has one of BOILERPLATE and under 12 words
  unpunctuated 10 or more words in a stretch of lines that no sentence closes: consecutive lines with words, none of which has a word
               that ends in one of ENDS, and after them no line that has one within LONGEST words of the stretch
Lines without a word are kept as they are, and end a stretch. So hard-wrapped prose, whose sentences end some lines further on, passes. A document is kept if the base rules pass and the lines that stay hold
at least `least_share` of the characters in words.

Defined cases: a null or wordless text has no word and fails; a document is judged for itself, so ties, repeated rows and
null ids change nothing; other columns are carried along (clean) or ignored (judge). Texts of any length are judged whole."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import frugal, slices

SYMBOLS = b"#*$%&|<>"
# Phrases of page furniture, in lower case, in the languages of the corpus.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "subscribe to our newsletter", "enable javascript", "click here to", "sign in to", "log in to",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "newsletter abonnieren", "javascript aktivieren", "klicken sie hier", "jetzt anmelden",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "suscríbete a nuestro boletín", "activa javascript", "haz clic aquí", "inicia sesión",
    "tous droits réservés", "politique de confidentialité", "politique de cookies", "conditions d'utilisation", "abonnez-vous à notre", "activez javascript", "cliquez ici", "se connecter à",
)
SEPARATORS = {b"|", b">", b"<", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2"}
# What sentences end in, in Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Chinese, Japanese, Armenian, Ethiopic, Khmer, Myanmar and Tibetan writing, and closing marks after that.
ENDS_IN = ".!?:;…\"'”’)]»׃؟۔؛।॥。！？．｡」』）։።፧፨។៕၊။།"
ENDS = tuple(x.encode() for x in ENDS_IN)
LEAST, LONGEST = 10, 100
JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bad_lines long, kept_word_chars long, base_failed boolean, kept boolean"


def _chars(data: bytes) -> int:
    """Code points of UTF-8."""
    return len(data) - len(data.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))


def line_fails(line: bytes, words: list[bytes]) -> bool:
    n, joined = len(words), b"".join(words)
    if n >= 3 and 4 * sum(w in SEPARATORS for w in words) > n:
        return True
    if 10 * (len(joined) - len(joined.translate(None, SYMBOLS))) > len(joined):
        return True
    if n >= 5:
        lettered = [w for w in words if w.lower() != w.upper()]
        if lettered and 2 * sum(w == w.upper() for w in lettered) > len(lettered):
            return True
    if n >= 20 and 5 * len(set(words)) < n:
        return True
    if n >= 12:
        return False
    lower = line.decode("utf-8", "replace").lower()
    return any(x in lower for x in BOILERPLATE)


def unclosed(lines: list[list[bytes]]) -> list[bool]:
    """For the words of each line: whether it is of LEAST words or more, in a stretch that no sentence closes."""
    out = [False] * len(lines)
    begin, size = 0, 0

    def end(k: int) -> None:
        for i in range(begin, k):
            out[i] = len(lines[i]) >= LEAST

    for k, words in enumerate(lines):
        closes = any(w.endswith(ENDS) for w in words)
        if words and not closes:
            size += len(words)
            continue
        if not words or size > LONGEST:
            end(k)
        begin, size = k + 1, 0
    end(len(lines))
    return out


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words in windows that the text has twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(windows)) == n:
        return 0
    count, end, found = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            found += i + window - max(i, end)
            end = i + window
    return found


def judge_text(text: str | None, least_share: float = 0.6, clean: bool = False) -> tuple:
    """The values of JUDGED, and with clean=True the text without its failing lines."""
    data = (text or "").encode()
    words = data.split()
    seen: set[bytes] = set()
    dup = bad = lost = 0
    stay: list[bytes] = []
    lines = data.split(b"\n")
    worded = [x.split() for x in lines]
    for line, own, fails in zip(lines, worded, unclosed(worded), strict=True):
        if own:
            dup += line in seen
            seen.add(line)
            fails = fails or line_fails(line, own)
            if fails:
                bad += 1
                lost += _chars(b"".join(own))
        if clean and not fails:
            stay.append(line)
    n, chars = len(words), _chars(b"".join(words))
    repeated = repeated_words(words)
    failed = n < 10 or 100 * repeated > 20 * n
    kept = not failed and chars - lost >= least_share * chars
    judged = (n, chars, len(data) - len(data.translate(None, SYMBOLS)), dup, repeated, bad, chars - lost, failed, kept)
    return (*judged, (b"\n".join(stay)).decode() if bad else text) if clean else judged


def judge(docs: DataFrame, least_share: float = 0.6) -> DataFrame:
    """doc_id and JUDGED for each row of docs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            columns = zip(*(judge_text(x, least_share) for x in batch.column(1).to_pylist()), strict=True)
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *re.findall(r"(\w+) \w+", JUDGED)])

    return docs.select("doc_id", "text").mapInArrow(frugal(of), f"doc_id long, {JUDGED}")


def clean(docs: DataFrame, least_share: float = 0.6) -> DataFrame:
    """The rows of docs that are kept, all their columns, with text (and n_chars, if there is one) after the failing lines went."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            at = batch.schema.get_field_index("text")
            found = [judge_text(x, least_share, clean=True) for x in batch.column(at).to_pylist()]
            batch = batch.set_column(at, "text", pa.array([x[-1] for x in found], batch.schema.field(at).type))
            yield batch.filter(pa.array([x[-2] for x in found]))

    kept = docs.mapInArrow(frugal(of), docs.schema)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept


#: The same by SQL, for documents. Each rule of line_fails is one line.
ORACLE = (
    r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs),
split AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines),
marked AS (SELECT *, len(w) = 0 AS blank, len(list_filter(w, lambda x: contains('ENDS_IN', x[-1]))) > 0 AS closes FROM split),
stretched AS (SELECT *, coalesce(sum((blank OR closes)::INT) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM marked),
worded AS (SELECT *, NOT closes AND (coalesce(bool_or(blank) OVER (PARTITION BY r, s), false) OR NOT bool_or(closes) OVER (PARTITION BY r, s)
  OR sum(CASE WHEN blank OR closes THEN 0 ELSE len(w) END) OVER (PARTITION BY r, s) > 100) AS loose FROM stretched),
real_lines AS (
  SELECT *, len(w) AS n, array_to_string(w, '') AS joined, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup,
    list_filter(w, lambda x: lower(x) <> upper(x)) AS lettered
  FROM worded WHERE len(w) > 0),
judged AS (
  SELECT *,
    (n >= 3 AND 4 * len(list_filter(w, lambda x: x IN ('|', '>', '<', '»', '›', '·', '•'))) > n)
    OR 10 * len(regexp_extract_all(joined, '[#*$%&|<>]')) > strlen(joined)
    OR (n >= 5 AND 2 * len(list_filter(lettered, lambda x: x = upper(x))) > len(lettered) AND len(lettered) > 0)
    OR (n >= 20 AND 5 * len(list_distinct(w)) < n)
    OR (n < 12 AND regexp_matches(lower(line), 'BOILERPLATE'))
    OR (n >= 10 AND loose) AS fails
  FROM real_lines),
by_line AS (SELECT r, sum(length(joined))::BIGINT AS word_chars, sum(n)::BIGINT AS n_words, count(*) FILTER (dup) AS n_dup_lines,
  count(*) FILTER (fails) AS n_bad_lines, coalesce(sum(length(joined)) FILTER (NOT fails), 0)::BIGINT AS kept_word_chars FROM judged GROUP BY r),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5),
grams AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM windows),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
base AS (
  SELECT r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(kept_word_chars, 0) AS kept_word_chars
  FROM docs LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, kept_word_chars, base_failed,
  NOT base_failed AND kept_word_chars >= 0.6 * word_chars AS kept
FROM failed
""".replace("ENDS_IN", ENDS_IN.replace("'", "''"))
    .replace("BOILERPLATE", "|".join(BOILERPLATE).replace("'", "''"))
)
