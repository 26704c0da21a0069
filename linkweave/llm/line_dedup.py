"""Removal of repeated passages by overlapping windows of three lines, with DataFrame functions only.

Lines are what \n separates. Every three consecutive lines with a word in them make a window, known by 96 bits of hashes
of its lines. The first occurrence of a window is the one with the smallest (doc_id, text hash, line); every other one is
a later occurrence, and the lines that later occurrences cover are merged into spans and removed.

A window's first occurrence comes from an aggregation with partial sums before the shuffle, so a passage with a third of
all windows is a row for each task there; the join back is an ordinary equi-join that adaptive execution splits.

Defined cases: a null text has no line and stays null; a text with fewer than three lines has no window; windows of three
blank lines are none; ids may be null (first in order) or repeated: rows that agree in id and text count as one
document and get one result each, rows that agree in id alone are told apart by the text's hash; other columns are carried
along, whatever they are named (but deduplicated()'s own n_lines, n_removed and n_spans, which take the place of columns so named;
clean() keeps those); an empty table gives an empty result. Texts are read whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import apart

LINES = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _hashed(docs: DataFrame) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("x"), F.hash(x).alias("m"), x.rlike(HAS_WORD).alias("w")))
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines"))


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line (from 0), w1 and w2 (the hashes) of each window."""

    def of(i: Column) -> Column:
        three = [F.get("lines", i + k) for k in range(LINES)]
        worded = three[0]["w"] | three[1]["w"] | three[2]["w"]
        return F.when(worded, F.struct(i.cast("int").alias("line"), F.xxhash64(*[x["x"] for x in three]).alias("w1"), F.hash(*[x["m"] for x in three]).alias("w2")))

    long_enough = _hashed(docs).where(F.size("lines") >= LINES)
    found = long_enough.select("doc_id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), of)).alias("w"))
    return found.where("w is not null").select("doc_id", "text_hash", "w.line", "w.w1", "w.w2")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the sorted numbers of the lines to remove, for documents that have some."""
    each = windows(docs)
    first = each.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "text_hash", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = each.join(first.drop("n"), ["w1", "w2"]).where(~F.struct("doc_id", "text_hash", "line").eqNullSafe(F.col("first")))
    starts = later.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("starts"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x, x + LINES - 1)))))
    return starts.select("doc_id", "text_hash", covered.alias("covered"))


def _gaps(covered: Column, n: Column) -> Column:
    """The ranges of lines between the covered ones, as (lo, hi)."""
    gaps = F.transform(F.sequence(F.lit(0), F.size(covered)), lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(covered, i - 1) + 1).alias("lo"), F.when(i == F.size(covered), n).otherwise(F.get(covered, i)).alias("hi")))
    return F.filter(gaps, lambda g: g["hi"] > g["lo"])


@apart
def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with text after removal, and n_lines, n_removed, n_spans (int)."""
    names = docs.columns
    cut = repeated_lines(docs).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("covered").alias("__covered"))
    keyed = docs.withColumn("__own", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    joined = keyed.join(cut, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    split = joined.withColumn("__lines", F.when(F.col("__covered").isNotNull(), F.split("text", "\n", -1)))
    ranged = split.withColumn("__gaps", _gaps(F.col("__covered"), F.size("__lines")))
    kept = F.array_join(F.flatten(F.transform("__gaps", lambda g: F.slice("__lines", g["lo"] + 1, g["hi"] - g["lo"]))), "\n")
    text = F.when(F.col("__covered").isNull(), F.col("text")).otherwise(kept)
    spans = F.size(F.filter("__covered", lambda x, i: (i == 0) | (F.get(F.col("__covered"), i - 1) < x - 1)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    counts = {"n_lines": n_lines.cast("int"), "n_removed": F.coalesce(F.when(F.col("__covered").isNotNull(), F.size("__covered")), F.lit(0)), "n_spans": F.coalesce(F.when(F.col("__covered").isNotNull(), spans), F.lit(0))}
    clash = [c for c in names if c in counts]
    return ranged.select(*[text.alias("text") if c == "text" else F.col(c) for c in names if c not in clash], *[c.alias(n) for n, c in counts.items()])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans, kept_chars and kept_sha256 for each document."""
    done = deduplicated(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_removed", "n_spans", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


@apart
def clean(docs: DataFrame) -> DataFrame:
    """docs, all their columns, after removal (n_chars too, if there is one); without documents that lost their last word."""
    done = deduplicated(docs)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(HAS_WORD)).select(*docs.columns) if not {"n_lines", "n_removed", "n_spans"} & set(docs.columns) else _carried(docs)
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done


def _carried(docs: DataFrame) -> DataFrame:
    """clean() for tables that have columns named as the counts: they are set aside meanwhile."""
    aside = docs.select(*[F.col(c).alias(f"__own_{c}" if c in ("n_lines", "n_removed", "n_spans") else c) for c in docs.columns])
    return clean(aside.withColumnRenamed("n_chars", "__own_n_chars")).select(*[F.col(x).alias(c) for c in docs.columns for x in [f"__own_{c}" if c in ("n_lines", "n_removed", "n_spans", "n_chars") else c]])


#: The same by SQL, for documents.
ORACLE = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM docs WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, text, unnest(range(1, len(l) - 1)) AS i, l FROM split WHERE len(l) >= 3),
windows AS (SELECT doc_id, text, i, l[i] || chr(10) || l[i+1] || chr(10) || l[i+2] AS w FROM numbered),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, i) AS k FROM windows
  WHERE regexp_matches(w, '[^\x20\x09-\x0D]')) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM later),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM split),
marked AS (SELECT lines.*, gone.i IS NOT NULL AS bad FROM lines LEFT JOIN gone USING (doc_id, i)),
runs AS (SELECT *, bad AND NOT coalesce(lag(bad) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
kept AS (SELECT doc_id, count(*)::INT AS n_lines, (count(*) FILTER (bad))::INT AS n_removed, (count(*) FILTER (begins))::INT AS n_spans,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') AS t FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  length(coalesce(t, '')) AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
