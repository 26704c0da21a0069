
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.checkpoints import buckets, dealt, tabled
from linkweave.operators import store
from linkweave.operators.store import LEVELS
from linkweave.policy import Policy

POLICY = Policy()
VERSION, STRIP = "Lua_547", "nostrip"
#: What pairs are dealt by: environment and callee, as joins with anchors ask for them.
PAIR_KEYS = ("lua_version", "architecture", "dst_name")


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(view: Callable[[Tables], DataFrame], *keys: str, ready: bool = False) -> cached_property:
    """A view that is written once for each session and folder, as a user's store and case files are there before a run; in buckets by keys, if there are any."""

    @wraps(view)
    def read(self: Tables) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, view.__name__)
        if key not in _STORED:
            _STORED[key] = dealt(view(self), *keys, lasting=True, ready=ready) if keys else tabled(view(self), lasting=True)
        return _STORED[key]

    return cached_property(read)


def _name(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        arch = F.when(F.col("l_linestatus") == "O", "x86_64").otherwise("aarch64")
        level = F.when(F.col("l_returnflag") == "N", "O0").when(F.col("l_returnflag") == "A", "O2").otherwise("O3")
        return self.read("lineitem").select(_name("S", "l_suppkey").alias("src_name"), _name("P", "l_partkey").alias("dst_name"), arch.alias("architecture"), level.alias("opt_level"))

    @cached_property
    def _calls(self) -> DataFrame:
        nations = self.read("supplier").select(_name("N", "s_nationkey").alias("src_name"), _name("S", "s_suppkey").alias("dst_name"), F.explode(F.array(F.lit("x86_64"), F.lit("aarch64"))).alias("architecture"), F.lit("O0").alias("opt_level"))
        return self._lines.unionByName(nations)

    @cached_property
    def edges(self) -> DataFrame:
        # dealt by pair, so that what is grouped by pairs afterwards needs no further shuffle
        return self._as_edges(self._calls.repartition("src_name", "dst_name").distinct())

    def _as_edges(self, rows: DataFrame) -> DataFrame:
        return rows.select("src_name", "dst_name", F.lit("calls").alias("edge_type"), F.lit("reference").alias("graph_role"), F.lit(VERSION).alias("lua_version"), "architecture", "opt_level", F.lit(STRIP).alias("strip_mode"))

    @(lambda view: stored(view, *PAIR_KEYS, ready=True))
    def pairs(self) -> DataFrame:
        """The edges as the engine reads them: pairs with the levels at which they are seen, in buckets by callee."""
        return store.pair_levels(self._as_edges(self._calls).repartition(buckets(self.spark), *PAIR_KEYS))

    @stored
    def functions(self) -> DataFrame:
        """Names of all edges; parts of the first type are external."""
        parts = self.read("part")
        first = parts.agg(F.min("p_type").alias("t"))
        external = parts.join(F.broadcast(first), F.col("p_type") == F.col("t")).select(_name("P", "p_partkey").alias("function_name"), F.lit("reference_external").alias("__role"))
        names = self.pairs.select(F.explode(F.array("src_name", "dst_name")).alias("function_name")).distinct()
        return names.join(external, "function_name", "left").select("function_name", F.coalesce("__role", F.lit("reference")).alias("graph_role"))

    @cached_property
    def features(self) -> DataFrame:
        """A feature tree: a row for each supplier, level and architecture with the parts it calls, in one of two files; small parts (p_size at most 5) are rows
        of their own in the file of their key's parity, those of size 1 in both."""
        env = ["architecture", "opt_level"]
        callers = self._lines.where("src_name is not null").groupBy("src_name", *env).agg(F.collect_list("dst_name").alias("callees"))
        own = callers.select(F.col("src_name").alias("function_name"), *env, "callees", F.substring("src_name", 2, 20).cast("long").alias("row"))
        own = own.withColumn("file", F.pmod("row", F.lit(2)))
        levels = F.explode(F.array(*[F.struct(F.lit(a).alias("architecture"), F.lit(o).alias("opt_level")) for a in ("x86_64", "aarch64") for o in ("O0", "O2", "O3")])).alias("e")
        files = F.explode(F.when(F.col("p_size") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.pmod("p_partkey", F.lit(2)).cast("int")))).alias("file")
        small = self.read("part").where("p_size <= 5").select("p_partkey", files).select("p_partkey", "file", levels)
        small = small.select(_name("P", "p_partkey").alias("function_name"), "e.architecture", "e.opt_level", F.lit(None).cast("array<string>").alias("callees"), (F.col("p_partkey") + 1_000_000).alias("row"), F.col("file").cast("long").alias("file"))
        rows = own.unionByName(small)
        path = F.concat_ws("/", F.lit(VERSION), "architecture", "opt_level", F.lit(STRIP), F.concat(F.lit("part"), F.col("file").cast("string"), F.lit(".json")))
        rows = rows.withColumns({"source_json": path, "lua_version": F.lit(VERSION), "strip_mode": F.lit(STRIP), "entry_point": F.lit(None).cast("string")})
        return rows.select("function_name", "callees", "row", "source_json", F.split("source_json", "/").alias("path_parts"), *LEVELS, "entry_point")

    @(lambda view: stored(view, "o_custkey"))
    def _orders(self) -> DataFrame:
        """Order lines by customer, which the three views below group in place."""
        lines = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.read("orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))

    @stored
    def cases(self) -> DataFrame:
        best = self._orders.groupBy("o_custkey").agg(F.min(F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber", "l_suppkey")).alias("b"))
        expected = best.select("o_custkey", F.concat(F.lit("S"), F.col("b.l_suppkey").cast("string")).alias("expected_function"))
        customers = self.read("customer")
        return customers.join(expected, customers.c_custkey == expected.o_custkey, "left").select(
            F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("mode"), F.col("c_nationkey").alias("query_file"), _name("C", "c_custkey").alias("query_func"), F.lit(VERSION).alias("lua_version"),
            F.when(F.col("c_custkey") % 2 == 0, "x86_64").otherwise("aarch64").alias("architecture"), "expected_function",
        )

    @stored
    def listed(self) -> DataFrame:
        """Retrieval: the five suppliers with the largest quantities of a customer."""
        sums = self._orders.groupBy(F.col("o_custkey").alias("case_id"), "l_suppkey").agg(F.sum("l_quantity").alias("w")).withColumn("name", _name("S", "l_suppkey"))
        order = Window.partitionBy("case_id").orderBy(F.desc("w"), "name")
        ranked = sums.withColumn("rank", F.row_number().over(order)).where("rank <= 5").withColumn("m", F.max("w").over(Window.partitionBy("case_id")))
        return ranked.select("case_id", (F.col("rank") - 1).alias("pos"), "name", F.round(F.lit(0.6) + F.lit(0.1) * F.col("w") / F.col("m"), 6).alias("prior"), "rank")

    @stored
    def neighbours(self) -> DataFrame:
        parts = self._orders.select(F.col("o_custkey").alias("case_id"), "l_partkey").distinct().select("case_id", _name("P", "l_partkey").alias("name"))
        callees = parts.select("case_id", F.lit("callee").alias("relation"), (F.row_number().over(Window.partitionBy("case_id").orderBy("name")) - 1).alias("pos"), "name")
        return callees.unionByName(self.read("customer").select(F.col("c_custkey").alias("case_id"), F.lit("caller").alias("relation"), F.lit(0).alias("pos"), _name("N", "c_nationkey").alias("name")))

    @cached_property
    def mappings(self) -> DataFrame:
        """Accepted mappings of parts of size 10 at most and of nations to themselves; larger parts' are deferred."""
        parts = self.read("part").select(_name("P", "p_partkey").alias("n"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") <= 10, "accepted").otherwise("deferred").alias("status"))
        nations = self.read("nation").select(_name("N", "n_nationkey").alias("n"), F.col("n_nationkey").cast("long").alias("pos"), F.lit("accepted").alias("status"))
        return parts.unionByName(nations).select("pos", F.col("n").alias("query_function_id"), F.col("n").alias("query_function_name"), F.col("n").alias("reference_function_id"), F.col("n").alias("reference_function_name"), "status")

    @cached_property
    def query_edges(self) -> DataFrame:
        """The query graph: customers call the parts they order, nations call their customers."""
        down = self._orders.select(_name("C", "o_custkey").alias("src"), _name("P", "l_partkey").alias("dst"))
        up = self.read("customer").select(_name("N", "c_nationkey").alias("src"), _name("C", "c_custkey").alias("dst"))
        return down.unionByName(up).withColumn("edge_type", F.lit("calls"))

    @cached_property
    def retrieval(self) -> DataFrame:
        """`listed` as retrieval of one query graph."""
        c = self.cases.select("case_id", F.col("query_func").alias("query_id"), "architecture")
        return self.listed.join(c, "case_id").select("query_id", "architecture", "pos", "name", "prior", "rank")
