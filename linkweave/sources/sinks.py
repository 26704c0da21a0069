"""The stored graph, feature trees and JSON documents."""

from __future__ import annotations

import hashlib
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.checkpoints import discard, fresh, tabled
from linkweave.operators.store import Pairs, all_pair_levels
from linkweave.sources import schemas

PARTITIONS = ("lua_version", "architecture", "strip_mode")
STORE_VERSION = "0.1"
COMMITS = "_commits"
#: A store's tables of pairs, and the end by which each is in buckets.
ENDS = {"pairs_by_callee": "dst_name", "pairs_by_caller": "src_name"}
ENV_KEYS = ("lua_version", "architecture")
#: Fewer buckets than shuffle partitions would have Spark shuffle them after all.
LEAST_BUCKETS = 16


def metadata_rows(root: str, source: str = "feature_tree") -> dict[str, str]:
    """The five rows that say what a store was built from, and how it is laid out."""
    return {"schema_version": STORE_VERSION, "source": source, "input_root": root, "graph_role": "reference", "storage_model": "parquet_edge_list"}


class _Folder:
    """A folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> JavaObject:
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _commits(folder: _Folder) -> list[str]:
    """Names of the store's commits, the last one last; those that are being written begin with a dot."""
    return [n for n in folder.names(COMMITS) if not n.startswith(".")]


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether there is a store below path."""
    return bool(_commits(_Folder(spark, path)))


def write_store(functions: DataFrame, edges: DataFrame, path: str, metadata: dict[str, str] | None = None, replace: bool = False, buckets: int | None = None) -> None:
    """A store below path: functions, edges, metadata, and the edges' pairs twice, in buckets by caller and by callee; a store that is there is
    refused unless replace is set.

    Tables go into a folder of their own; the commit is one small file with that folder's name, which gets a number of its own by a rename, last. Readers take the
    last commit, so they see the old store or the new one whole, whatever fails in between, and of two writers one is refused. The version
    before the last is kept for those who read it still, older ones are removed."""
    spark = functions.sparkSession
    folder, version = _Folder(spark, path), f"version-{uuid.uuid4().hex}"
    before = _commits(folder)
    if before and not replace:
        raise FileExistsError(f"there is a store at {path}")
    held = f"{folder.path}/{version}"
    try:
        # rows of an environment are dealt by name, so that a lookup by name reads few row groups
        functions.repartition(*PARTITIONS, "function_name").sortWithinPartitions("function_name").write.partitionBy(*PARTITIONS).parquet(f"{held}/functions")
        edges.repartition(*PARTITIONS, "src_name").sortWithinPartitions("src_name", "dst_name").write.partitionBy(*PARTITIONS).parquet(f"{held}/edges")
        n = buckets or max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        calls = tabled(all_pair_levels(spark.read.schema(schemas.EDGES).parquet(f"{held}/edges")))  # as written: edges are computed once
        for name, end in ENDS.items():
            keys = [*ENV_KEYS, end]
            # a task writes whole buckets: dealt as buckets are, a file each
            dealt = calls.repartition(n, *keys)
            dealt.write.bucketBy(n, *keys).sortBy(end).option("path", f"{held}/{name}").format("parquet").saveAsTable(_catalog_name(f"{held}/{name}"))
            spark.sql(f"DROP TABLE {_catalog_name(f'{held}/{name}')}")  # its name alone
        discard(calls)
        spark.createDataFrame(sorted((metadata or {}).items()), schemas.METADATA).coalesce(1).write.parquet(f"{held}/metadata")
        spark.createDataFrame([(version, n)], "version string, buckets int").coalesce(1).write.json(f"{folder.path}/{COMMITS}/.{version}")
        number = f"{int(before[-1]) + 1 if before else 1:012d}"
        if folder.fs.exists(folder.at(f"{COMMITS}/{number}")) or not folder.fs.rename(folder.at(f"{COMMITS}/.{version}"), folder.at(f"{COMMITS}/{number}")):
            raise FileExistsError(f"another store was committed at {path} meanwhile")
    except BaseException:
        folder.remove(version)
        folder.remove(f"{COMMITS}/.{version}")
        if not before:
            for name in (COMMITS, ""):
                if not folder.names(name):
                    folder.remove(name)
        raise
    for old in before[:-1]:
        row = spark.read.json(f"{folder.path}/{COMMITS}/{old}").first()
        folder.remove(f"{COMMITS}/{old}")
        folder.remove(row["version"])


def _catalog_name(path: str) -> str:
    """The session's name of a table in buckets; the files know nothing of it."""
    return f"linkweave_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def stored(spark: SparkSession, path: str) -> tuple[str, int]:
    """The folder of the store's last commit, and in how many buckets its pairs are."""
    folder = _Folder(spark, path)
    commits = _commits(folder)
    if not commits:
        raise FileNotFoundError(f"there is no store at {path}")
    row = spark.read.schema("version string, buckets int").json(f"{folder.path}/{COMMITS}/{commits[-1]}").first()
    return f"{folder.path}/{row['version']}", row["buckets"]


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Functions and edges of a store."""
    held, _ = stored(spark, path)
    return spark.read.schema(schemas.FUNCTIONS).parquet(f"{held}/functions"), spark.read.schema(schemas.EDGES).parquet(f"{held}/edges")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Key and value."""
    return spark.read.schema(schemas.METADATA).parquet(f"{stored(spark, path)[0]}/metadata")


def read_pairs(spark: SparkSession, path: str, strip_mode: str = "nostrip") -> Pairs:
    """The pairs of a store with their levels, in buckets by callee and by caller: what is joined with them by one of these is dealt as the buckets are, and they stay.

    Buckets are known to the session's catalog alone, so their tables are named in it; dropping those names leaves the files."""
    held, n = stored(spark, path)
    tables = []
    for name, end in ENDS.items():
        table = _catalog_name(f"{held}/{name}")
        place = f"{held}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        columns = "lua_version STRING, architecture STRING, strip_mode STRING, src_name STRING, dst_name STRING, opt_levels ARRAY<STRING>"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({', '.join([*ENV_KEYS, end])}) SORTED BY ({end}) INTO {n} BUCKETS LOCATION '{place}'")
        tables.append(spark.table(table).where(F.col("strip_mode") == strip_mode).drop("strip_mode"))
    return Pairs(*tables)


def write_documents(rows: DataFrame, path: str, replace: bool = False) -> None:
    """A JSON document a row; text keeps its characters."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite" if replace else "errorifexists").text(path)


def write_document(lines: DataFrame, path: str, replace: bool = False) -> None:
    """One file of the rows of `lines` in the order of its partitions, as of plans.documents.document().

    Executors write a part for each partition. The parts are joined beside path, by the file system itself where it can (HDFS moves blocks and copies nothing),
    else by a copy through a small buffer, and get their name by a rename: there is no half document at path."""
    spark = lines.sparkSession
    folder, name = _Folder(spark, path.rstrip("/").rpartition("/")[0] or "."), path.rstrip("/").rpartition("/")[2]
    if folder.fs.exists(folder.at(name)) and not replace:
        raise FileExistsError(f"there is a document at {path}")
    held = f".{name}-{uuid.uuid4().hex}"
    try:
        lines.select("value").write.text(f"{folder.path}/{held}")
        # names begin with the partition's number, of five digits or more
        parts = sorted((n for n in folder.names(held) if n.startswith("part-")), key=lambda n: int(n.split("-")[1]))
        whole = folder.at(f"{held}/whole")
        _joined(spark, folder, [folder.at(f"{held}/{n}") for n in parts], whole)
        if replace:
            folder.remove(name)
        if not folder.fs.rename(whole, folder.at(name)):
            raise FileExistsError(f"there is a document at {path}")
    finally:
        folder.remove(held)


def _joined(spark: SparkSession, folder: _Folder, parts: list[JavaObject], whole: JavaObject) -> None:
    jvm = spark.sparkContext._jvm
    out = folder.fs.create(whole)
    if folder.fs.getScheme() == "hdfs" and parts:
        out.close()
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
        for k, part in enumerate(parts):
            array[k] = part
        folder.fs.concat(whole, array)
        return
    try:
        for part in parts:
            source = folder.fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
            folder.fs.delete(part, False)  # so that there is no second copy of the whole
    finally:
        out.close()


def write_files(files: DataFrame, root: str) -> None:
    """Text files below root: a row (path, value) is one file. The executors write them; each then gets its name by one rename."""
    spark = files.sparkSession
    held = fresh(spark, "files")
    # quoted, as a folder of the writer can't be named by a path
    quoted = F.regexp_replace("path", "/", "|")
    files.select(quoted.alias("path"), "value").repartition("path").write.partitionBy("path").text(held, lineSep="\n")
    _named(spark, held, root)


def _named(spark: SparkSession, held: str, root: str) -> None:
    """Files below root of the folders path=... in held; several parts are joined in the order of their numbers."""
    folder = _Folder(spark, held)
    for name in folder.names(""):
        if not name.startswith("path="):
            continue
        target = folder._hadoop.Path(f"{root}/{_unquoted(name.removeprefix('path='))}")
        folder.fs.mkdirs(target.getParent())
        parts = sorted((n for n in folder.names(name) if n.startswith("part-")), key=lambda n: int(n.split("-")[1]))
        whole = folder.at(f"{name}/{parts[0]}")
        if len(parts) > 1:
            whole = folder.at(f"{name}/whole")
            _joined(spark, folder, [folder.at(f"{name}/{n}") for n in parts], whole)
        if not folder.fs.rename(whole, target):
            raise FileExistsError(str(target))
    folder.remove("")


def _unquoted(name: str) -> str:
    return name.replace("%7C", "|").replace("|", "/")


def write_features(features: DataFrame, root: str) -> None:
    """A feature tree: one JSON array of each source_json's rows, in order of `row`. features: source_json, row, and columns of schemas.FEATURES.

    Rows are dealt by ranges of file and row, so a large file is written as parts by many tasks; those are joined in their order."""
    own = [c for c in features.columns if c not in ("source_json", "row")]
    # quoted, as a folder of the writer can't be named by a path; numbered, as rows may be alike
    quoted = F.regexp_replace("source_json", "/", "|")
    rows = tabled(features.select(quoted.alias("path"), "row", F.to_json(F.struct(*own)).alias("f"), F.monotonically_increasing_id().alias("id")))
    at = F.struct("row", "f", "id")
    ends = rows.groupBy("path").agg(F.min(at).alias("first"), F.max(at).alias("last"))  # a row for each file
    told = rows.join(F.broadcast(ends), "path")
    line = F.concat(F.when(F.col("id") == F.col("first.id"), "[").otherwise(""), "f", F.when(F.col("id") == F.col("last.id"), "]").otherwise(","))
    order = ["path", "row", "f", "id"]
    spark = features.sparkSession
    held = fresh(spark, "files")
    told.select(*order, line.alias("value")).repartitionByRange(*order).sortWithinPartitions(*order).select("path", "value").write.partitionBy("path").text(held, lineSep="\n")
    discard(rows)
    _named(spark, held, root)


def summary_lines(summary: DataFrame) -> list[str]:
    """Name: value lines of a one-row summary."""
    row = summary.first()
    return [f"{k}: {v}" for k, v in (row.asDict() if row else {}).items()]


def store_lines(path: str, files: int, counts: DataFrame) -> list[str]:
    """What building a store prints: totals, and functions by environment."""
    rows = counts.orderBy("lua_version", "architecture", "opt_level", "strip_mode").collect()  # a row for each environment
    total = {c: sum(r[c] for r in rows) for c in ("functions", "edges", "external_calls")}
    head = [f"[OK] wrote store: {path}", f"Feature files : {files}", f"Functions     : {total['functions']}", f"Edges         : {total['edges']}", f"External edges: {total['external_calls']}", "By environment:"]
    return head + [f"  {r['lua_version']:7} {r['architecture']:7} {r['opt_level']:2} {r['strip_mode']:7} functions={r['functions']}" for r in rows]
