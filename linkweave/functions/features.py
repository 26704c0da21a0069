"""Expressions over a function's static features (review records)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions.names import col, name_summary

# Strings that point to a loader of binary chunks.
LOADER_STRINGS = ("chunk", "lua_integer", "lua_number")


def none_is_empty(x: Column | str, kind: str) -> Column:
    return F.coalesce(col(x), F.array().cast(f"array<{kind}>"))


def top_items(histogram: Column | str, limit: int = 10) -> Column:
    """(name, count) by count, larger first; ties keep the map's order."""
    entries = F.map_entries(col(histogram))
    ranked = F.array_sort(F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("k"), i.alias("i"), e["key"].alias("name"), e["value"].alias("count"))))
    items = F.transform(F.slice(ranked, 1, limit), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count")))
    return F.coalesce(items, F.array().cast("array<struct<name:string,count:int>>"))


def compare_sample(compare: Column | str, limit: int = 8) -> Column:
    """The first values over all offsets, and the number of offsets."""
    entries = F.coalesce(F.map_entries(col(compare)), F.array().cast("array<struct<key:string,value:array<string>>>"))
    flat = F.flatten(F.transform(entries, lambda e: F.transform(F.slice(F.coalesce(e["value"], F.array().cast("array<string>")), 1, limit), lambda v: F.struct(e["key"].alias("offset"), v.alias("value")))))
    return F.struct(F.size(entries).alias("offset_count"), F.slice(flat, 1, limit).alias("sample"))


def feature_tags(strings: Column | str, callees: Column | str, callers: Column | str, instructions: Column | str, blocks: Column | str) -> Column:
    """I4: tags of a function, in the order of the rules."""
    s, c = none_is_empty(strings, "string"), none_is_empty(callees, "string")
    n, b = F.coalesce(col(instructions), F.lit(0)), F.coalesce(col(blocks), F.lit(0))

    def loader(x: Column) -> Column:
        found = F.lit(False)
        for part in LOADER_STRINGS:
            found = found | x.contains(part)
        return F.coalesce(found, F.lit(False))

    rules = (
        ("string_rich", F.size(s) > 0),
        ("binary_chunk_or_loader_related_strings", F.exists(s, loader)),
        ("large_complex_function", (n >= 500) | (b >= 40)),
        ("small_api_wrapper_like_function", (n <= 120) & (b <= 5)),
        ("call_heavy", F.size(c) >= 8),
        ("no_strings", F.size(s) == 0),
        ("few_visible_callers", name_summary(callers)["visible_count"] <= 1),
    )
    return F.array_compact(F.array(*[F.when(rule, tag) for tag, rule in rules]))


#: The type of a feature summary.
SUMMARY = (
    "struct<function_name_debug_label:string,architecture:string,lua_version:string,basic_block_count:int,pcode_instruction_count:int,top_pcode_opcodes:array<struct<name:string,count:int>>,"
    "strings:array<string>,string_count:int,callees:struct<total_count:int,visible_count:int,anonymous_count:int,visible_names:array<string>>,"
    "callers:struct<total_count:int,visible_count:int,anonymous_count:int,visible_names:array<string>>,struct_offsets:array<int>,struct_offset_count:int,"
    "compare_constants:struct<offset_count:int,sample:array<struct<offset:string,value:string>>>,feature_tags:array<string>>"
)


def feature_summary(present: Column) -> Column:
    """Summary struct of the feature columns in scope; null where `present` is false."""
    summary = F.struct(
        F.col("function_name").alias("function_name_debug_label"), F.col("architecture"), F.col("lua_version"), F.col("basic_block_count"), F.col("pcode_instruction_count"),
        top_items("pcode_opcode_histogram").alias("top_pcode_opcodes"),
        F.slice(none_is_empty("strings", "string"), 1, 20).alias("strings"), F.size(none_is_empty("strings", "string")).alias("string_count"),
        name_summary("callees").alias("callees"), name_summary("callers").alias("callers"),
        F.slice(none_is_empty("struct_offsets", "int"), 1, 20).alias("struct_offsets"), F.size(none_is_empty("struct_offsets", "int")).alias("struct_offset_count"),
        compare_sample("compare").alias("compare_constants"),
        feature_tags("strings", "callees", "callers", "pcode_instruction_count", "basic_block_count").alias("feature_tags"),
    )
    return F.when(present, summary)
