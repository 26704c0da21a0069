"""Whole result documents (A15) and the lines that a run prints of its cases.

A document is one JSON text of a header, a summary and all records, as the scripts' users expect it. It is a table of lines whose partitions, in their order,
are that text; sources.sinks.write_document() writes them as parts and joins those. Results without a header are written by row: sources.sinks.write_documents()."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkweave.checkpoints import tabled
from linkweave.operators import metrics, scoring
from linkweave.operators.review import ITEMS, anchor_items
from linkweave.plans.runs import Scored
from linkweave.policy import Policy

VERSION = "0.1"


def _candidate(policy: Policy) -> Column:
    return F.struct(
        F.col("name").alias("candidate_function_name"), F.col("prior").alias("retrieval_prior"), "original_rank", "candidate_source", "graph_score", "final_score", "final_rank",
        scoring.breakdown(policy).alias("graph_breakdown"), "evidence",
    )


def _ranked(done: Scored, policy: Policy, most: int | None, name: str) -> DataFrame:
    rows = done.ranked if most is None else done.top(most)
    listed = F.array_sort(F.collect_list(F.struct("final_rank", _candidate(policy).alias("c"))))
    return rows.groupBy("case_id").agg(F.transform(listed, lambda x: x["c"]).alias(name))


def propagation_records(done: Scored, policy: Policy) -> DataFrame:
    """A record for each case of a run from anchors: decision, counts, anchors, ties and the best candidates."""
    rows = done.results.join(anchor_items(done.anchors, 30), "case_id", "left").join(_ranked(done, policy, policy.output_top_candidates, "top_candidates"), "case_id", "left")
    items = lambda c: F.coalesce(c, F.array().cast(ITEMS)).alias(c)
    anchors = F.struct("callee_anchor_count", "caller_anchor_count", items("callee_anchors"), items("caller_anchors")).alias("anchor_summary")
    return rows.select(
        "case_id", "mode", "query_file", "query_func", "architecture", "expected_function", "predicted_function_name", "status", "status_reasons", "expected_final_rank", "top1_hit",
        "candidate_count", "retrieval_candidate_count", "expanded_candidate_count", anchors, "top_tied_candidates", "top_candidates",
    )


def evaluation_records(done: Scored, policy: Policy) -> DataFrame:
    """A record for each case of an evaluation: hits before and after, counts, anchors and all candidates."""
    rows = done.results.join(anchor_items(done.anchors, 50), "case_id", "left").join(_ranked(done, policy, None, "candidates"), "case_id", "left")
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["reference_function_name"]), F.array().cast("array<string>")).alias(c)
    anchors = F.struct("callee_anchor_count", "caller_anchor_count", names("callee_anchors"), names("caller_anchors")).alias("anchor_summary")
    return rows.select(
        "case_id", "mode", "query_file", "query_func", "architecture", "expected_function", "retrieval_top1", "propagation_top1", "retrieval_top1_hit", "propagation_top1_hit", "propagation_top3_hit",
        "propagation_top5_hit", "expected_final_rank", "expected_in_retrieval_candidates", "expected_in_candidates", "top1_changed", "candidate_count", "retrieval_candidate_count", "expanded_candidate_count",
        anchors, "candidates",
    )


def _text(x: Column) -> Column:
    return F.to_json(x, {"ignoreNullFields": "false", "pretty": "true"})


_HEAD, _OPEN, _RECORD, _CLOSE = range(4)
#: Numbers of rows that are written already, and so are the same whenever they are read.
_ID = "__id"


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, written with a number each, which tells apart those of one key."""
    return tabled(rows.withColumn(_ID, F.monotonically_increasing_id()))


def document(header: dict[str, Column], parts: dict[str, DataFrame], records: dict[str, DataFrame], key: str = "case_id") -> DataFrame:
    """Rows `value` that are, one after another, a JSON document: the header's fields, the one row of each of parts, and each of records as an array in order of key.

    Records are dealt out by ranges of section and key and sorted there, so the partitions in their order are the document: nothing is gathered. They are written as
    columns before, where they have no number yet, and become text behind that: text, many times as large, is neither kept nor dealt out. What stands between
    two records belongs to the second; which one is a section's first is told by keys and numbers. sinks.write_document() makes a file of it."""
    spark = next(iter((*records.values(), *parts.values()))).sparkSession
    kind = next(iter(records.values())).schema[key].dataType if records else StringType()
    none, number = F.lit(None).cast(kind), F.lit(None).cast("long")

    def line(of: DataFrame, section: int, what: int, value: Column, at: Column = none, id_: Column = number, *more: Column) -> DataFrame:
        return of.select(F.lit(section).alias("section"), F.lit(what).alias("what"), at.alias("key"), id_.alias("id"), value.alias("value"), *more)

    one = spark.range(1)
    head = _text(F.struct(F.lit(VERSION).alias("schema_version"), *[c.alias(n) for n, c in header.items()]))
    rows = [line(one, 0, _HEAD, F.regexp_replace(head, r"\s*\}$", ""))]
    firsts, value = [], F.col("value")
    for section, (name, of) in enumerate([*parts.items(), *records.items()], 1):
        begin = F.lit(f',\n  "{name}" : ')
        if name in parts:
            rows.append(line(of, section, _HEAD, F.concat(begin, _text(F.struct("*")))))
        else:
            own = of if _ID in of.columns else _numbered(of)
            record = F.struct(*[c for c in own.columns if c != _ID]).alias(f"record{section}")
            rows += [line(one, section, _OPEN, F.concat(begin, F.lit("["))), line(own, section, _RECORD, F.lit(None).cast("string"), F.col(key), F.col(_ID), record), line(one, section, _CLOSE, F.lit("]"))]
            firsts.append(own.agg(F.min(F.struct(F.col(key).alias("key"), F.col(_ID).alias("id"))).alias("f")).select(F.lit(section).alias("section"), "f.id"))
            value = F.when((F.col("section") == section) & (F.col("what") == _RECORD), _text(F.col(f"record{section}"))).otherwise(value)
    rows.append(line(one, len(parts) + len(records) + 1, _HEAD, F.lit("}")))
    order = ["section", "what", "key", "id"]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    dealt = every.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    begun = functools.reduce(DataFrame.unionByName, firsts).collect() if firsts else []  # a row for each section
    follows = F.col("what") == _RECORD
    for r in begun:
        if r["id"] is not None:
            follows = follows & ~((F.col("section") == r["section"]) & (F.col("id") == r["id"]))
    return dealt.select(F.when(follows, F.concat(F.lit(", "), value)).otherwise(value).alias("value"))


def _expansion(policy: Policy) -> Column:
    return F.struct(F.lit(policy.expansion_enabled).alias("enabled"), F.lit(policy.expansion_prior).alias("default_prior"), F.lit(policy.expansion_limit).alias("max_candidates_per_case"))


def _anchors(policy: Policy) -> Column:
    return F.struct(F.lit(policy.allow_visible_names).alias("allow_visible_reference_name_anchors"), F.array(*map(F.lit, policy.exclude_prefixes)).cast("array<string>").alias("exclude_prefixes"))


def _scoring(policy: Policy) -> Column:
    values = {"primary_opt": policy.primary_opt, "strip_mode": policy.strip_mode, "primary_edge_bonus": policy.primary_bonus, "auxiliary_edge_bonus": policy.auxiliary_bonus, "missing_anchor_penalty": policy.missing_penalty}
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def propagation_document(done: Scored, policy: Policy, suite_name: str | None = None, description: str | None = None) -> DataFrame:
    done = done.kept(policy.output_top_candidates)  # others are in no record
    decision = F.struct(*[F.lit(getattr(policy, x)).alias(x) for x in ("accept_margin", "min_primary_matches", "max_tied_top_candidates")])
    header = {"suite_name": F.lit(suite_name), "description": F.lit(description), "anchor_policy": _anchors(policy), "candidate_expansion": _expansion(policy), "classification_policy": decision}
    return document(header, {"summary": metrics.status_summary(done.results)}, {"results": propagation_records(done, policy)})


def evaluation_document(done: Scored, policy: Policy, suite_name: str | None = None, description: str | None = None) -> DataFrame:
    done = done.kept()
    both = tabled(metrics.summaries(done.results))
    modes = metrics.summary_by_mode(done.results, both)
    entry = F.struct("mode", F.struct(*[c for c in modes.columns if c != "mode"]).alias("s"))
    by_mode = modes.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("modes"))
    header = {"suite_name": F.lit(suite_name), "description": F.lit(description), "anchor_policy": _anchors(policy), "candidate_expansion": _expansion(policy), "scoring": _scoring(policy)}
    return document(header, {"summary": metrics.summary(done.results, both), "by_mode": by_mode}, {"cases": evaluation_records(done, policy)})


def analysis_document(records: DataFrame, source: str, suite_name: str | None = None) -> DataFrame:
    """Deferred cases and conflicts apart, with counts of both, of the categories and of attached features."""
    records = _numbered(records)  # read three times
    each = records.groupBy("review_category", "status").agg(F.count("*").alias("n"), F.count_if(F.col("query_feature_summary").isNotNull()).alias("f"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0))
    per = each.groupBy("review_category").agg(F.sum("n").alias("n"), of("deferred").alias("d"), of("conflict").alias("c"), F.sum("f").alias("f"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    summary = per.agg(total("d").alias("deferred_count"), total("c").alias("conflict_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("review_category", "n")))).alias("category_counts"), total("f").alias("feature_summary_attached"))
    header = {"description": F.lit("Deferred and conflicting cases of a run from anchors, for review by people or a local language model."), "source_file": F.lit(source), "source_suite_name": F.lit(suite_name)}
    parts = {f"{s}_cases": records.where(F.col("status") == s).drop("status") for s in ("deferred", "conflict")}
    return document(header, {"summary": summary}, parts)


def analyst_document(rows: DataFrame, source: str, provider: str = "dry-run", model: str | None = None) -> DataFrame:
    told = rows.agg(F.count("*").alias("num_cases"), *[F.count_if(F.col("status") == s).alias(n) for n, s in (("completed", "completed"), ("prompt_exported", "prompt_exported"), ("errors", "error"))])
    header = {"description": F.lit("Advice of a local language model on deferred and conflicting cases; it changes no mapping."), "input_json": F.lit(source), "provider": F.lit(provider), "model": F.lit(model)}
    return document(header, {"summary": told}, {"results": rows})


def query_graph_document(ranked: DataFrame, results: DataFrame, summary: DataFrame, policy: Policy, inputs: dict[str, str]) -> DataFrame:
    """The document of one query graph: each query with all its candidates."""
    listed = F.array_sort(F.collect_list(F.struct("final_rank", _candidate(policy).alias("c"))))
    every = ranked.groupBy(F.col("case_id").alias("query_id"), "architecture").agg(F.transform(listed, lambda x: x["c"]).alias("candidates"))
    rows = results.join(every, "query_id").select(F.col("query_id").alias("query_function_id"), "architecture", F.col("expected_function").alias("expected_function_name"), "retrieval_top1", "propagation_top1", "top1_changed", "candidates")
    header = {"mode": F.lit("deterministic_callgraph_propagation_mvp"), "inputs": F.struct(*[F.lit(v).alias(k) for k, v in inputs.items()]), "scoring": _scoring(policy)}
    return document(header, {"metrics": summary}, {"results": rows}, "query_function_id")


def _shown(of: str) -> Column:
    """A value as the scripts print it: a missing one is None."""
    return F.coalesce(F.col(of).cast("string"), F.lit("None"))


def propagation_lines(results: DataFrame) -> DataFrame:
    """case_id and the line printed of each decision."""
    return results.select("case_id", F.concat(F.col("case_id").cast("string"), F.lit(": "), "status", F.lit(" pred="), _shown("predicted_function_name"), F.lit(" expected="), _shown("expected_function"), F.lit(" rank="), _shown("expected_final_rank"), F.lit(" reasons="), F.array_join("status_reasons", ",")).alias("line"))


def evaluation_lines(results: DataFrame) -> DataFrame:
    """case_id and the line printed of each evaluated case."""
    sides = F.concat(F.lit(" anchors="), F.col("callee_anchor_count").cast("string"), F.lit("c/"), F.col("caller_anchor_count").cast("string"), F.lit("r"))
    return results.select("case_id", F.concat(F.col("case_id").cast("string"), F.lit(": "), "retrieval_top1", F.lit(" -> "), "propagation_top1", F.lit(" expected="), _shown("expected_function"), sides).alias("line"))


def review_lines(records: DataFrame) -> DataFrame:
    """case_id and the line printed of each deferred case."""
    rows = records.where("status = 'deferred'")
    return rows.select("case_id", F.concat(F.col("case_id").cast("string"), F.lit(": "), "review_category", F.lit(" top="), _shown("current_top_prediction"), F.lit(" expected_rank="), _shown("expected_final_rank"), F.lit(" action="), "recommended_action").alias("line"))
