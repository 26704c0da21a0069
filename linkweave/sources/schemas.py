"""Schemas of the inputs and of the stored graph. Always passed to readers: inference would turn maps into structs."""

FEATURES = (
    "function_name STRING, entry_point STRING, architecture STRING, lua_version STRING, callees ARRAY<STRING>, callers ARRAY<STRING>, strings ARRAY<STRING>, "
    "basic_block_count INT, pcode_instruction_count INT, pcode_opcode_histogram MAP<STRING,INT>, struct_offsets ARRAY<INT>, compare MAP<STRING,ARRAY<STRING>>"
)
RETRIEVAL = (
    "schema_version STRING, source STRING, retrieval_mode STRING, candidate_policy STRING, queries ARRAY<STRUCT<query_function_id: STRING, query_function_name: STRING, "
    "metadata: STRUCT<architecture: STRING, source_json: STRING>, candidates: ARRAY<STRUCT<candidate_function_id: STRING, candidate_function_name: STRING, rank: INT, "
    "score_total: DOUBLE, score_breakdown: STRUCT<symbolic: DOUBLE, numeric: DOUBLE, semantic: DOUBLE>>>>>"
)
GRAPH = (
    "schema_version STRING, graph_id STRING, graph_type STRING, nodes ARRAY<STRUCT<function_id: STRING, function_name: STRING, entry_point: STRING, metadata: MAP<STRING,STRING>>>, "
    "edges ARRAY<STRUCT<src: STRING, dst: STRING, edge_type: STRING>>"
)
ANCHORS = (
    "schema_version STRING, mappings ARRAY<STRUCT<query_function_id: STRING, query_function_name: STRING, reference_function_id: STRING, reference_function_name: STRING, "
    "confidence: DOUBLE, source: STRING, status: STRING, evidence: ARRAY<STRING>>>"
)
SUITE = (
    "suite_name STRING, candidate_source STRING, output_top_candidates INT, anchor_policy STRUCT<type: STRING, allow_visible_reference_name_anchors: BOOLEAN, exclude_prefixes: ARRAY<STRING>>, "
    "candidate_expansion STRUCT<enabled: BOOLEAN, default_prior: DOUBLE, max_candidates_per_case: INT>, scoring STRUCT<primary_opt: STRING, strip_mode: STRING>, "
    "classification_policy STRUCT<accept_margin: DOUBLE, min_primary_matches: INT, max_tied_top_candidates: INT>, cases ARRAY<STRUCT<case_id: STRING, expected_function: STRING>>"
)
CASES = (
    "cases ARRAY<STRUCT<case_id: STRING, mode: STRING, query_file: STRING, query_func: STRING, expected_function: STRING, "
    "{source}: ARRAY<STRUCT<function_name: STRING, score_total: DOUBLE, source_json: STRING>>>>"
)
FUNCTIONS = "function_id STRING, function_name STRING, graph_role STRING, lua_version STRING, architecture STRING, opt_level STRING, strip_mode STRING, entry_point STRING, source_json STRING"
EDGES = "src_id STRING, dst_id STRING, src_name STRING, dst_name STRING, edge_type STRING, graph_role STRING, lua_version STRING, architecture STRING, opt_level STRING, strip_mode STRING, source_json STRING"
METADATA = "key STRING, value STRING"
