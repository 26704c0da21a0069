"""Registered queries of readers, sinks, and documents: each writes files from the test tables, reads them back and is compared with SQL over the tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.checkpoints import fresh
from linkweave.operators import anchors as A
from linkweave.operators import review, store
from linkweave.plans import documents, runs
from linkweave.plans.adapter import POLICY, VERSION, Tables
from linkweave.plans.queries import CATEGORY, DECIDED, FEATURES, GRAPH, HYBRID_METRICS, REVIEW, _features, _records, _run, joined, millionths, query
from linkweave.policy import Policy
from linkweave.sources import readers, sinks

#: Files that a reader has to leave out, each for one reason.
DECOYS = ("Lua_547/x86_64/O0/part0.json", "Lua_547/mips/O0/nostrip/part0.json", "Other/x86_64/O0/nostrip/part0.json", "Lua_547/x86_64/P0/nostrip/part0.json", "Lua_547/x86_64/O0/half/part0.json", "Lua_547/x86_64/O0/nostrip/part0.txt")
#: In the tree the directory of aarch64 has its other name.
TREE_PATH = "replace(source_json, 'aarch64', 'arm64')"


def _tree(t: Tables) -> str:
    """A feature tree on disk: the views' features, and files that are none."""
    root = fresh(t.spark, "tree")
    rows = t.features.select(F.expr(TREE_PATH).alias("source_json"), "row", "function_name", F.lit("00100000").alias("entry_point"), F.array_sort(F.coalesce("callees", F.array().cast("array<string>"))).alias("callees"), F.create_map(F.lit("B"), F.lit(1), F.lit("A"), F.lit(2)).alias("pcode_opcode_histogram"))
    # a row without a name, and a second one under a name that was there before, behind all others
    more = rows.groupBy("source_json").agg(F.max("row").alias("row"), F.min("function_name").alias("function_name"))
    none = F.lit(None).cast("array<string>")
    again = more.select("source_json", (F.col("row") + 1).alias("row"), "function_name", F.lit("second").alias("entry_point"), none.alias("callees"), F.lit(None).cast("map<string,int>").alias("pcode_opcode_histogram"))
    empty = again.withColumns({"row": F.col("row") + 1, "function_name": F.lit("")})
    sinks.write_features(rows.unionByName(again).unionByName(empty), root)
    sinks.write_files(t.spark.createDataFrame([(p, "[]") for p in DECOYS], "path string, value string"), root)
    return root


ROWS = """, put AS (SELECT 'Lua_547/' || replace(architecture, 'aarch64', 'arm64') || '/' || opt_level || '/nostrip/part' || f || '.json' AS source_json, architecture, opt_level, function_name, r, f, '00100000' AS entry_point FROM defined),
placed AS (SELECT *, row_number() OVER (PARTITION BY source_json ORDER BY r) - 1 AS row FROM put),
again AS (SELECT source_json, architecture, opt_level, min(function_name) AS function_name, f, max(row) AS last FROM placed GROUP BY ALL),
rows_ AS (SELECT source_json, architecture, opt_level, row, function_name, entry_point, f FROM placed UNION ALL SELECT source_json, architecture, opt_level, last + 1, function_name, 'second', f FROM again
  UNION ALL SELECT source_json, architecture, opt_level, last + 2, '', 'second', f FROM again),
called_ AS (SELECT 'Lua_547/' || replace(architecture, 'aarch64', 'arm64') || '/' || opt_level || '/nostrip/part' || f || '.json' AS source_json, src_name AS function_name, list(dst_name ORDER BY dst_name) AS callees FROM called GROUP BY ALL)
"""


@query(FEATURES + ROWS + "SELECT DISTINCT source_json, 'Lua_547' AS lua_version, architecture, opt_level, 'nostrip' AS strip_mode FROM put")
def feature_files(t: Tables) -> DataFrame:
    """The feature files of a tree with others among them, and the environments of their paths."""
    return readers.feature_paths(t.spark, _tree(t)).select("source_json", "lua_version", "architecture", "opt_level", "strip_mode")


@query(FEATURES + ROWS + """SELECT r.source_json, r.architecture, r.opt_level, r.row::INT AS row, r.function_name, r.entry_point, CASE WHEN entry_point <> 'second' THEN coalesce(array_to_string(callees, ';'), '') END AS callees, CASE WHEN entry_point <> 'second' THEN 'B=1;A=2' END AS histogram
FROM rows_ r LEFT JOIN called_ USING (source_json, function_name)""")  # fmt: skip
def feature_rows(t: Tables) -> DataFrame:
    """A3: every row of every file in its place, maps in their order."""
    rows = readers.read_features(t.spark, _tree(t))
    histogram = joined(F.transform(F.map_entries("pcode_opcode_histogram"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("source_json", "architecture", "opt_level", "row", "function_name", "entry_point", joined(F.array_sort(F.array_distinct("callees"))).alias("callees"), histogram.alias("histogram"))


@query(FEATURES + ROWS + "SELECT source_json, function_name, row::INT AS row, entry_point FROM rows_ WHERE function_name <> '' AND entry_point <> 'second'")
def first_feature(t: Tables) -> DataFrame:
    """The first row of each name of a file; rows without a name aren't found."""
    return readers.first_features(readers.read_features(t.spark, _tree(t))).select("source_json", "function_name", "row", "entry_point")


STORED = FEATURES + """, vertices AS (SELECT function_name, 'reference' AS graph_role, architecture, opt_level FROM defined UNION SELECT dst_name, 'reference_external', architecture, opt_level FROM calls WHERE NOT internal)
"""


@query(STORED + """SELECT 'function' AS kind, graph_role AS role, architecture, opt_level, count(*) AS rows, sum(length(function_name))::BIGINT AS letters FROM vertices GROUP BY ALL
UNION ALL SELECT 'edge', CASE WHEN internal THEN 'ref' ELSE 'external' END, architecture, opt_level, count(*), sum(length(src_name) + length(dst_name))::BIGINT FROM calls GROUP BY ALL""")  # fmt: skip
def store_tables(t: Tables) -> DataFrame:
    """A store built from a tree on disk, written, and read again."""
    path = fresh(t.spark, "store")
    runs.build_tree(t.spark, _tree(t), path)
    functions, edges = sinks.read_store(t.spark, path)
    total = lambda *c: F.sum(sum((F.length(x) for x in c), F.lit(0))).alias("letters")
    a = functions.groupBy(F.lit("function").alias("kind"), F.col("graph_role").alias("role"), "architecture", "opt_level").agg(F.count("*").alias("rows"), total("function_name"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.split("dst_id", "::")[0].alias("role"), "architecture", "opt_level").agg(F.count("*").alias("rows"), total("src_name", "dst_name")))


@query("""SELECT * FROM (VALUES ('graph_role', 'reference'), ('input_root', 'the tree'), ('schema_version', '0.1'), ('source', 'feature_tree'), ('storage_model', 'parquet_edge_list')) v(key, value)""")
def store_metadata(t: Tables) -> DataFrame:
    """A12."""
    path, root = fresh(t.spark, "store"), _tree(t)
    runs.build_tree(t.spark, root, path)
    return sinks.read_metadata(t.spark, path).select("key", F.when(F.col("value") == root, "the tree").otherwise(F.col("value")).alias("value"))


@query("SELECT * FROM (VALUES (1, 'no files', 'refused'), (2, 'new', 'written'), (3, 'there already', 'refused'), (4, 'replace', 'written')) v(step, case_name, outcome)")
def store_modes(t: Tables) -> DataFrame:
    """A tree without files and a store that is there are refused; replacing writes."""
    path, root, nothing = fresh(t.spark, "store"), _tree(t), fresh(t.spark, "tree")
    sinks.write_files(t.spark.createDataFrame([(p, "[]") for p in DECOYS], "path string, value string"), nothing)
    rows = []
    for step, (name, tree, replace) in enumerate((("no files", nothing, False), ("new", root, False), ("there already", root, False), ("replace", root, True)), 1):
        try:
            runs.build_tree(t.spark, tree, path, replace)
            outcome = "written"
        except (runs.NoFiles, FileExistsError):
            outcome = "refused"
        rows.append((step, name, outcome))
    return t.spark.createDataFrame(rows, "step int, case_name string, outcome string")


@query(FEATURES + """, n AS (SELECT architecture, opt_level, count(*) AS functions FROM (SELECT DISTINCT function_name, architecture, opt_level, f FROM defined) GROUP BY ALL),
files AS (SELECT DISTINCT architecture, opt_level, f FROM defined), extra AS (SELECT architecture, opt_level, count(*) AS k FROM files GROUP BY ALL),
lines_ AS (SELECT 1 AS step, '' AS key, 'Feature files : ' || (SELECT count(*) FROM files) AS line UNION ALL SELECT 2, '', 'Functions     : ' || ((SELECT sum(functions) FROM n) + (SELECT count(*) FROM files))
  UNION ALL SELECT 3, '', 'Edges         : ' || (SELECT count(*) FROM calls) UNION ALL SELECT 4, '', 'External edges: ' || (SELECT count(*) FROM calls WHERE NOT internal) UNION ALL SELECT 5, '', 'By environment:'
  UNION ALL SELECT 6, architecture || opt_level, '  Lua_547 ' || rpad(architecture, 7, ' ') || ' ' || opt_level || ' nostrip functions=' || (functions + k) FROM n JOIN extra USING (architecture, opt_level))
SELECT (row_number() OVER (ORDER BY step, key))::INT AS "at", line FROM lines_""")  # fmt: skip
def store_report(t: Tables) -> DataFrame:
    """What building a store prints, but for its path."""
    lines = runs.build_tree(t.spark, _tree(t), fresh(t.spark, "store"))
    return t.spark.createDataFrame([(k, x) for k, x in enumerate(lines) if k], "at int, line string")


def _put(rows: DataFrame, header: dict[str, Column], field: str, name: str, order: str = "at") -> str:
    """A JSON document on disk: a header, and rows (order, and the entry as `e`) as one array."""
    path = fresh(rows.sparkSession, name)
    sinks.write_document(documents.document({n: c for n, c in header.items() if n != "schema_version"}, {}, {field: rows.select(order, "e.*")}, order), path)
    return path


@query(GRAPH + "SELECT (row_number() OVER (ORDER BY c.case_id) - 1)::INT AS query_pos, c.query_func AS query_id, architecture, l.pos, l.name, round(prior * 1000000)::BIGINT AS prior, rank FROM cases c LEFT JOIN listed l USING (case_id)".replace("(row_number() OVER (ORDER BY c.case_id) - 1)::INT", "(dense_rank() OVER (ORDER BY c.case_id) - 1)::INT"))
def retrieval_document(t: Tables) -> DataFrame:
    """A4: a retrieval document; queries without candidates have a row without one."""
    listed = t.listed.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "rank", "prior"))).alias("l"))
    one = lambda x: F.struct(x["name"].alias("candidate_function_name"), x["rank"].alias("rank"), x["prior"].alias("score_total"))
    entry = F.struct(F.col("query_func").alias("query_function_id"), F.struct("architecture").alias("metadata"), F.transform("l", one).alias("candidates"))
    path = _put(t.cases.join(listed, "case_id", "left").select(F.col("case_id").alias("at"), entry.alias("e")), {"schema_version": F.lit("0.1")}, "queries", "retrieval")
    return readers.read_retrieval(t.spark, path).select("query_pos", "query_id", "architecture", "pos", "name", millionths("prior").alias("prior"), "rank")


@query("""SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS pos, query_function_id, status FROM (SELECT p_partkey AS k, 'P' || p_partkey AS query_function_id, CASE WHEN p_size <= 10 THEN 'accepted' ELSE 'deferred' END AS status FROM part
UNION ALL SELECT -1 - n_nationkey, 'N' || n_nationkey, 'accepted' FROM nation)""")  # fmt: skip
def mapping_document(t: Tables) -> DataFrame:
    """A4: anchor mappings in their order."""
    at = F.when(F.col("query_function_id").startswith("N"), -1 - F.col("pos")).otherwise(F.col("pos"))
    path = _put(t.mappings.select(at.alias("at"), F.struct("query_function_id", "query_function_name", "reference_function_name", "status").alias("e")), {"schema_version": F.lit("0.1")}, "mappings", "mappings")
    return readers.read_mappings(t.spark, path).select("pos", "query_function_id", "status")


@query(GRAPH + "SELECT DISTINCT 'C' || o_custkey AS src, 'P' || l_partkey AS dst, 'calls' AS edge_type FROM bought UNION SELECT 'N' || c_nationkey, 'C' || c_custkey, 'references' FROM customer")
def query_graph_store(t: Tables) -> DataFrame:
    """A query graph with two types of edges, read from a document, written to a store beside the reference's, and read again."""
    edges = t.query_edges.distinct().withColumn("edge_type", F.when(F.col("src").startswith("N"), "references").otherwise("calls"))
    path = _put(edges.select(F.concat_ws(">", "src", "dst").alias("at"), F.struct("src", "dst", "edge_type").alias("e")), {"schema_version": F.lit("0.1")}, "edges", "graph")
    mine = store.query_graph(readers.read_query_edges(t.spark, path), VERSION, "x86_64", "O0", "nostrip", "query.json")
    reference = runs.build_store(t.features)[:2]
    held = fresh(t.spark, "store")
    sinks.write_store(*[a.unionByName(b) for a, b in zip(mine, reference, strict=True)], held)
    return store.stored_query_edges(sinks.read_store(t.spark, held)[1])


SUITE = {
    "suite_name": "customers", "candidate_source": "unique_topk_preview", "output_top_candidates": 3, "anchor_policy": {"allow_visible_reference_name_anchors": True, "exclude_prefixes": ["P1"]},
    "candidate_expansion": {"enabled": True, "default_prior": 0.6, "max_candidates_per_case": 7}, "scoring": {"primary_opt": "O2"}, "classification_policy": {"accept_margin": 0.02},
}


def _suite(t: Tables) -> str:
    """A suite of the even customers, those of every third without an expected name of its own."""
    entry = F.struct(F.col("case_id").cast("string").alias("case_id"), F.when(F.col("case_id") % 3 != 0, F.concat(F.lit("own"), F.col("case_id").cast("string"))).alias("expected_function"))
    rows = t.cases.where("case_id % 2 = 0").select(F.col("case_id").alias("at"), entry.alias("e"))
    return _put(rows, {k: F.parse_json(F.lit(json.dumps(v))) for k, v in SUITE.items()}, "cases", "suite")


def _case_file(t: Tables) -> str:
    """Retrieval cases of all customers, each twice: the later one counts."""
    listed = t.listed.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "prior"))), lambda x: F.struct(x["name"].alias("function_name"), x["prior"].alias("score_total"))).alias("unique_topk_preview"))
    rows = t.cases.join(listed, "case_id", "left").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    file = F.concat(F.lit("Lua_547/arm64/O0/nostrip/"), F.col("query_file").cast("string"), F.lit(".json"))
    entry = F.struct(F.col("case_id").cast("string").alias("case_id"), F.when(F.col("turn") == 0, "old").otherwise(F.col("mode")).alias("mode"), file.alias("query_file"), "query_func", "expected_function", "unique_topk_preview")
    return _put(rows.select((F.col("turn") * 10_000_000 + F.col("case_id")).alias("at"), entry.alias("e")), {}, "cases", "cases")


def _query_tree(t: Tables) -> str:
    """Feature files of the customers, by nation; some rows say which architecture they are of."""
    root = fresh(t.spark, "tree")
    named = t.neighbours.groupBy("case_id").agg(*[F.array_compact(F.transform(F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.struct("pos", "name")))), lambda x: x["name"])).alias(f"{r}s") for r in ("callee", "caller")])
    rows = t.cases.join(named, "case_id", "left").select(
        F.concat(F.lit("Lua_547/arm64/O0/nostrip/"), F.col("query_file").cast("string"), F.lit(".json")).alias("source_json"), F.col("case_id").alias("row"), F.col("query_func").alias("function_name"),
        F.when(F.col("case_id") % 4 == 0, "arm64").when(F.col("case_id") % 4 == 2, F.lit(None)).otherwise("x86_64").alias("architecture"), "callees", "callers",
    )
    sinks.write_features(rows, root)
    return root


@query("""SELECT * FROM (VALUES ('accept_margin', '0.02'), ('allow_visible_names', 'True'), ('exclude_prefixes', '(''P1'',)'), ('expansion_enabled', 'True'), ('expansion_limit', '9'), ('expansion_prior', '0.6'), ('max_tied_top_candidates', '1'),
('min_primary_matches', '1'), ('output_top_candidates', '3'), ('primary_opt', 'O2'), ('strip_mode', 'nostrip')) v(setting, value)""")  # fmt: skip
def suite_policy(t: Tables) -> DataFrame:
    """A10: settings of a suite document, with one changed from outside."""
    policy, _ = readers.read_suite(t.spark, _suite(t), expansion_limit=9)
    names = ("accept_margin", "allow_visible_names", "exclude_prefixes", "expansion_enabled", "expansion_limit", "expansion_prior", "max_tied_top_candidates", "min_primary_matches", "output_top_candidates", "primary_opt", "strip_mode")
    return t.spark.createDataFrame([(n, str(getattr(policy, n))) for n in names], "setting string, value string")


def _bound(t: Tables) -> tuple[DataFrame, DataFrame]:
    policy, suite = readers.read_suite(t.spark, _suite(t))
    cases, _ = readers.read_cases(t.spark, _case_file(t))
    return readers.bind_cases(suite, cases, readers.read_features(t.spark, _query_tree(t)), policy)


@query(GRAPH + """SELECT case_id::VARCHAR AS case_id, mode, 'Lua_547/arm64/O0/nostrip/' || query_file || '.json' AS query_file, query_func, CASE WHEN case_id % 4 = 0 THEN 'aarch64' ELSE 'x86_64' END AS architecture, 'Lua_547' AS lua_version,
  CASE WHEN case_id % 3 <> 0 THEN 'own' || case_id ELSE expected_function END AS expected_function FROM cases WHERE case_id % 2 = 0""")  # fmt: skip
def bound_cases(t: Tables) -> DataFrame:
    """Suite cases with their retrieval case and their feature row, read from files."""
    return _bound(t)[0].select("case_id", "mode", "query_file", "query_func", "architecture", "lua_version", "expected_function")


@query(GRAPH + "SELECT case_id::VARCHAR AS case_id, relation, pos, name FROM neighbours WHERE case_id % 2 = 0")
def bound_neighbours(t: Tables) -> DataFrame:
    """Callees and callers of the feature rows, in order."""
    return _bound(t)[1].select("case_id", "relation", "pos", "name")


@query(GRAPH + "SELECT case_id::VARCHAR AS case_id, pos, name, round(prior * 1000000)::BIGINT AS prior FROM listed")
def case_candidates(t: Tables) -> DataFrame:
    """A10: candidates of the retrieval cases, the last of each id."""
    return readers.read_cases(t.spark, _case_file(t))[1].select("case_id", "pos", "name", millionths("prior").alias("prior"))


@query("SELECT 'C' || n_nationkey AS query_id, n_name || '=x' AS expected_function FROM nation")
def expected_items(t: Tables) -> DataFrame:
    """ID=NAME items, cut at the first sign, the last of an id."""
    names = t.read("nation").select("n_nationkey", "n_name").collect()  # as from a command line
    return readers.parse_expected(t.spark, [f"C{k}=old" for k, _ in names] + [f"C{k}={n}=x" for k, n in names]).withColumnRenamed("expected", "expected_function")


@query(GRAPH + """, firsts AS (SELECT case_id, name FROM neighbours WHERE relation = 'callee' AND pos = 0)
SELECT n.case_id, n.relation, n.pos, n.name AS anchor FROM neighbours n SEMI JOIN ref_names r ON r.name = n.name ANTI JOIN firsts f ON f.case_id = n.case_id AND f.name = n.name""")  # fmt: skip
def self_calls(t: Tables) -> DataFrame:
    """Cases named as their first callee, which is then no neighbour of its own."""
    first = t.neighbours.where("relation = 'callee' AND pos = 0").select("case_id", F.col("name").alias("first"))
    cases = t.cases.join(first, "case_id", "left").withColumn("query_func", F.coalesce("first", "query_func")).drop("first")
    return A.visible_neighbours(t.neighbours, cases, store.reference_names(t.functions), Policy.hybrid()).select("case_id", "relation", "pos", "anchor")


# Whole documents and printed lines


def _read(document: DataFrame, name: str) -> readers.Document:
    """A document, written as a file and read again as JSON."""
    path = fresh(document.sparkSession, name)
    sinks.write_document(document, path)
    return readers.Document(document.sparkSession, path)


ITEM = "struct<query_neighbor_name:string,reference_function_name:string,source:string>"
CANDIDATE = "struct<candidate_function_name:string,retrieval_prior:double,original_rank:int,candidate_source:string,graph_score:double,final_score:double,final_rank:int,graph_breakdown:struct<primary_matches:bigint,auxiliary_matches:bigint,missing_anchor_edges:bigint,primary_edge_bonus:double>,evidence:array<string>>"
STATUS = "struct<case_count:bigint,accepted:bigint,deferred:bigint,conflict:bigint,top1_accuracy:double>"


def _line(c: Column) -> Column:
    """Candidates in one line."""
    one = lambda x: F.concat_ws("|", x["final_rank"], x["original_rank"], x["candidate_function_name"], millionths(x["retrieval_prior"]), millionths(x["final_score"]), x["graph_breakdown"]["primary_matches"], x["graph_breakdown"]["missing_anchor_edges"], x["candidate_source"], joined(x["evidence"], ","))
    return F.coalesce(joined(F.transform(c, one)), F.lit(""))


LISTED = "SELECT case_id, string_agg(concat_ws('|', final_rank, rank, name, round(prior * 1000000)::BIGINT, round(final_score * 1000000)::BIGINT, primary_matches, missing_anchor_edges, candidate_source, array_to_string(evidence[1:{e}], ',')), ';' ORDER BY final_rank) AS line FROM ranked WHERE final_rank <= {n} GROUP BY case_id"


@query(REVIEW + f""", listings AS ({LISTED.format(e=30, n=5)}) SELECT (row_number() OVER (ORDER BY case_id) - 1)::INT AS "at", case_id, query_func, predicted AS predicted_function_name, status, array_to_string(reasons, ';') AS reasons, coalesce(s.callees, '') AS callees, callee_anchor_count, coalesce(line, '') AS line
FROM results LEFT JOIN sides s USING (case_id) LEFT JOIN listings USING (case_id)""")  # fmt: skip
def propagation_document(t: Tables) -> DataFrame:
    """The results of a run's document, in their order."""
    result = f"struct<case_id:bigint,query_func:string,predicted_function_name:string,status:string,status_reasons:array<string>,anchor_summary:struct<callee_anchor_count:bigint,callee_anchors:array<{ITEM}>>,top_candidates:array<{CANDIDATE}>>"
    rows = _read(documents.propagation_document(_run(t), POLICY, "customers"), "propagation").entries("results", result).toDF("at", "r")
    items = joined(F.transform("r.anchor_summary.callee_anchors", lambda x: F.concat_ws("=", x["query_neighbor_name"], x["reference_function_name"], x["source"])))
    return rows.select("at", "r.case_id", "r.query_func", "r.predicted_function_name", "r.status", joined("r.status_reasons").alias("reasons"), items.alias("callees"), "r.anchor_summary.callee_anchor_count", _line(F.col("r.top_candidates")).alias("line"))


@query(DECIDED + """SELECT '0.1' AS schema_version, 'customers' AS suite_name, 80::INT AS expansion_limit, 15000::BIGINT AS accept_margin, count(*) AS case_count, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (status = 'conflict') AS conflict,
  round(round(count(*) FILTER (top1_hit) / count(*) FILTER (expected_function <> ''), 6) * 1000000)::BIGINT AS top1 FROM results""")  # fmt: skip
def propagation_header(t: Tables) -> DataFrame:
    """Header and summary of the document."""
    schema = f"schema_version string, suite_name string, candidate_expansion struct<max_candidates_per_case:int>, classification_policy struct<accept_margin:double>, summary {STATUS}"
    d = _read(documents.propagation_document(_run(t), POLICY, "customers"), "propagation").header(schema)
    return d.select("schema_version", "suite_name", F.col("candidate_expansion.max_candidates_per_case").alias("expansion_limit"), millionths("classification_policy.accept_margin").alias("accept_margin"), "summary.case_count", "summary.accepted", "summary.deferred", "summary.conflict", millionths("summary.top1_accuracy").alias("top1"))


@query(DECIDED + "SELECT coalesce(nullif(mode, ''), 'unknown') AS mode, case_count, improved FROM (SELECT mode, " + HYBRID_METRICS + " GROUP BY 1)")
def evaluation_modes(t: Tables) -> DataFrame:
    """The summaries by mode of an evaluation's document."""
    d = _read(documents.evaluation_document(_run(t), POLICY), "evaluation").header("by_mode struct<modes:map<string,struct<case_count:bigint,improved:bigint>>>")
    return d.select(F.explode("by_mode.modes").alias("mode", "s")).select("mode", "s.case_count", "s.improved")


@query(REVIEW + f""", listings AS ({LISTED.format(e=30, n=1000)}) SELECT case_id, retrieval_top1, propagation_top1, top1_changed, coalesce(line, '') AS line, coalesce(regexp_replace(regexp_replace(s.callees, '=[^;]*', '', 'g'), ';', ',', 'g'), '') AS callees FROM flags LEFT JOIN listings USING (case_id) LEFT JOIN sides s USING (case_id)""")
def evaluation_document(t: Tables) -> DataFrame:
    """The cases of an evaluation's document, with all candidates."""
    case = f"struct<case_id:bigint,retrieval_top1:string,propagation_top1:string,top1_changed:boolean,anchor_summary:struct<callee_anchors:array<string>>,candidates:array<{CANDIDATE}>>"
    rows = _read(documents.evaluation_document(_run(t), POLICY), "evaluation").entries("cases", case).toDF("at", "c")
    return rows.select("c.case_id", "c.retrieval_top1", "c.propagation_top1", "c.top1_changed", _line(F.col("c.candidates")).alias("line"), joined(F.slice("c.anchor_summary.callee_anchors", 1, 30), ",").alias("callees"))


@query(REVIEW + f"""SELECT 'deferred' AS part, (row_number() OVER (ORDER BY case_id) - 1)::INT AS "at", case_id, {CATEGORY} AS review_category FROM reviewed WHERE status = 'deferred'
UNION ALL SELECT 'conflict', (row_number() OVER (ORDER BY case_id) - 1)::INT, case_id, {CATEGORY} FROM reviewed WHERE status = 'conflict'
UNION ALL SELECT 'count', -1, count(*), {CATEGORY} FROM reviewed GROUP BY ALL UNION ALL SELECT 'features', -1, count(texts), '' FROM reviewed""")  # fmt: skip
def analysis_document(t: Tables) -> DataFrame:
    """Deferred cases and conflicts of a review's document, its counts by category and of features."""
    written = _read(documents.analysis_document(_records(t), "run.json"), "analysis")
    d = written.header("summary struct<category_counts:map<string,bigint>,feature_summary_attached:bigint>")
    parts = [written.entries(f"{n}_cases", "struct<case_id:bigint,review_category:string>").select(F.lit(n).alias("part"), F.col("pos").alias("at"), "e.case_id", "e.review_category") for n in ("deferred", "conflict")]
    counts = d.select(F.explode("summary.category_counts").alias("review_category", "case_id")).select(F.lit("count").alias("part"), F.lit(-1).alias("at"), "case_id", "review_category")
    features = d.select(F.lit("features").alias("part"), F.lit(-1).alias("at"), F.col("summary.feature_summary_attached").alias("case_id"), F.lit("").alias("review_category"))
    return parts[0].unionByName(parts[1]).unionByName(counts).unionByName(features)


@query(DECIDED + "SELECT case_id, 'prompt_exported' AS status, true AS has_prompt, count(*) OVER () AS num_cases, 0::BIGINT AS completed, 'dry-run' AS provider FROM results WHERE status <> 'accepted'")
def analyst_document(t: Tables) -> DataFrame:
    """The document of a dry run."""
    from linkweave.operators import analyst

    rows = analyst.dry_run(analyst.ordered(analyst.prompts(_records(t))))
    written = _read(documents.analyst_document(rows, "analysis.json"), "analyst")
    d = written.header("provider string, summary struct<num_cases:bigint,completed:bigint>")
    # the header is one row
    return written.entries("results", "struct<case_id:bigint,status:string,prompt:string>").toDF("at", "r").join(F.broadcast(d.withColumn("one", F.lit(True))), F.col("one")).select("r.case_id", "r.status", F.col("r.prompt").isNotNull().alias("has_prompt"), "summary.num_cases", "summary.completed", "provider")


@query(DECIDED + """SELECT case_id, case_id || ': ' || status || ' pred=' || coalesce(predicted, 'None') || ' expected=' || coalesce(expected_function, 'None') || ' rank=' || coalesce(expected_final_rank::VARCHAR, 'None') || ' reasons=' || array_to_string(reasons, ',') AS line FROM results""")
def propagation_report(t: Tables) -> DataFrame:
    """A line for each case of a run."""
    return documents.propagation_lines(_run(t).results)


@query(DECIDED + """SELECT case_id, case_id || ': ' || retrieval_top1 || ' -> ' || propagation_top1 || ' expected=' || coalesce(expected_function, 'None') || ' anchors=' || callee_anchor_count || 'c/' || caller_anchor_count || 'r' AS line FROM flags""")
def evaluation_report(t: Tables) -> DataFrame:
    """A line for each evaluated case."""
    return documents.evaluation_lines(_run(t).results)


@query(REVIEW + f"""SELECT case_id, case_id || ': ' || category || ' top=' || coalesce(predicted, 'None') || ' expected_rank=' || coalesce(expected_final_rank::VARCHAR, 'None') || ' action=' || CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in review.ACTIONS.items())} END AS line FROM reviewed WHERE status = 'deferred'""")
def review_report(t: Tables) -> DataFrame:
    """A line for each deferred case."""
    return documents.review_lines(runs.review_run(_run(t), _features(t), POLICY)[0])
