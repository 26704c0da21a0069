"""Expressions over names: truthiness, prefixes, identifiers, roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a name's prefix says about its role, in the order in which they are asked.
ROLES = (
    ("luaL_", "Lua auxiliary library API/helper", "luaL_ prefix"),
    ("lua_", "Lua public C API", "lua_ prefix"),
    ("luaV_", "Lua VM execution/runtime", "luaV_ prefix"),
    ("luaD_", "Lua call/stack/error runtime", "luaD_ prefix"),
    ("luaU_", "Lua binary chunk undump/load support", "luaU_ prefix"),
    ("luaX_", "Lua lexer/parser front-end", "lexer-related name"),
    ("luaC_", "Lua garbage collector", "luaC_ prefix"),
)
LEXER = ("llex", "Lua lexer/parser front-end", "lexer-related name")
OTHER_ROLE = ("Lua internal/static helper or custom candidate", "no public Lua API prefix")
NO_ROLE = ("unknown", "missing candidate name")
ANONYMOUS = ("FUNC_", "FUN_", "sub_")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(x: Column | str) -> Column:
    """Neither null nor empty (never null itself)."""
    return F.coalesce(col(x) != "", F.lit(False))


def has_prefix(x: Column | str, prefixes: Sequence[str]) -> Column:
    """Whether the name starts with one of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | col(x).startswith(p)
    return F.coalesce(found, F.lit(False))


def normalized_architecture(x: Column | str) -> Column:
    """A2."""
    return F.when(col(x) == "arm64", "aarch64").otherwise(col(x))


def function_id(kind: str, name: Column | str, *env: Column | str) -> Column:
    """B1: kind (ref or external), environment and name."""
    return F.concat_ws("::", F.lit(kind), *[col(x) for x in env], col(name))


def role_hint(name: Column | str) -> Column:
    """struct<role, rationale> of a candidate's name."""

    def answer(role: str, why: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(why).alias("rationale"))

    rule = F.when(~truthy(name), answer(*NO_ROLE))
    for prefix, role, why in ROLES:
        asked = col(name).startswith(prefix)
        rule = rule.when(asked | (col(name) == LEXER[0]) if prefix == "luaX_" else asked, answer(role, why))
    return rule.otherwise(answer(*OTHER_ROLE))


def name_summary(names: Column | str, limit: int = 12) -> Column:
    """Counts of all, visible and anonymous names, and the first visible ones; null is an empty list."""
    every = F.coalesce(col(names), F.array().cast("array<string>"))
    visible = F.filter(every, lambda x: truthy(x) & ~has_prefix(x, ANONYMOUS))
    return F.struct(F.size(every).alias("total_count"), F.size(visible).alias("visible_count"), (F.size(every) - F.size(visible)).alias("anonymous_count"), F.slice(visible, 1, limit).alias("visible_names"))
