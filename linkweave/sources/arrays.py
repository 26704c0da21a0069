"""Elements of large JSON arrays, read by many tasks for one file.

A file is read in pieces that end at a closing brace, from byte ranges, as Spark splits any text. Whether a piece begins inside a
string, and how deep, depends on all that precedes it: each range sums its quotes, and its depths for both cases; running sums over
ranges, a row for each, which every task gets a copy of, then settle every range's own beginning. An element ends where a brace outside strings leads back to the
array's depth. Its pieces are put together by its number, so one that crosses ranges is whole as well.

Defined cases: elements are objects; another kind, a missing bracket or comma, or text behind the array is an error when rows are
read. Files without a byte have no pieces: the caller looks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.checkpoints import buckets, dealt, discard, tabled

RANGE = ("path", "block")


def pieces(spark: SparkSession, root: str, over: int) -> DataFrame:
    """path, block (where its byte range begins), id (rising within a range) and text of each piece of JSON files of more than `over` bytes."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("lineSep", "}").text(root)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes")).where(F.col("bytes") > over).drop("bytes")


def document_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The same of one file, or of all files of a folder, whatever their names and sizes."""
    texts = spark.read.option("lineSep", "}").text(path)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))


def _opened(text: Column, inside: int) -> Column:
    """Opening less closing brackets outside strings of a text without escapes, which begins outside (0) or inside (1) of one."""
    plain = F.regexp_replace(F.concat(F.lit('"'), text) if inside else text, '"[^"]*"?', "")
    return F.length(F.translate(plain, "]}", "")) - F.length(F.translate(plain, "[{", ""))


def _stretches(pieces: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame]:
    """Texts between the braces outside strings that lead to the depth `deepest`, or (if it is over 1) to a lesser one: path, row (a stretch's place in its file), text
    (without its last brace), end (0: the rest of a file), begins and ends (depths), left (of the whole file). Also the table that they are read from.

    Pieces are dealt out by range once, and written in buckets with their running sums for both cases; what settles the ranges reads those numbers alone. A stretch
    inside a range is put together where it is; those that cross ranges, two for each, are dealt out by their place."""
    spark = pieces.sparkSession
    within = Window.partitionBy(*RANGE).orderBy("id")
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    plain = F.when(F.contains("text", F.lit("\\")), F.regexp_replace("text", r"(?s)\\.", "")).otherwise(F.col("text"))
    told = pieces.withColumn("plain", plain)
    # most pieces of flat records: one opening brace, ahead of all strings
    brace, quote, size = F.instr("plain", "{"), F.instr("plain", '"'), F.octet_length("plain")
    less = lambda c: size - F.octet_length(F.replace("plain", F.lit(c)))
    flat = ~F.contains("plain", F.lit("[")) & ~F.contains("plain", F.lit("]"))
    ahead = flat & (less("{") == 1) & ((quote == 0) | (brace < quote))
    opened = {k: F.when(flat & (brace == 0), 0).when(ahead, 1 - k).otherwise(_opened(F.col("plain"), k)) for k in (0, 1)}
    told = told.select(*RANGE, "id", "text", less('"').alias("quotes"), *[c.alias(f"opened{k}") for k, c in opened.items()]).repartition(buckets(spark), *RANGE)
    told = told.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)  # if the range begins outside strings

    def change(begins: int) -> Column:
        """How a piece and the brace that ends it change the depth."""
        inside = (F.col("inside") + begins) % 2
        return F.when(inside == 0, F.col("opened0")).otherwise(F.col("opened1")) - F.when((inside + F.col("quotes")) % 2 == 0, 1).otherwise(0)

    told = told.select(*RANGE, "id", "text", "quotes", "inside", change(0).alias("change0"), change(1).alias("change1"))
    told = dealt(told.withColumns({f"upto{k}": F.sum(f"change{k}").over(upto) for k in (0, 1)}), *RANGE, ready=True)
    ranges = told.groupBy(*RANGE).agg(F.sum("quotes").alias("quotes"), F.sum("change0").alias("sum0"), F.sum("change1").alias("sum1"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.withColumn("begins", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("begins") == 0, F.col("sum0")).otherwise(F.col("sum1"))
    ranges = ranges.select(*RANGE, "begins", F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("base"), F.sum(own).over(Window.partitionBy("path")).alias("left"))

    def placed(ranges: DataFrame) -> DataFrame:
        """Pieces with their depth, and whether a stretch ends with them. ranges: a row for each range."""
        rows = told.join(F.broadcast(ranges), [*RANGE])
        of = lambda c: F.when(F.col("begins") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
        outside = (F.col("inside") + F.col("begins") + F.col("quotes")) % 2 == 0
        depth = F.col("base") + of("upto")
        return rows.withColumns({"change": of("change"), "depth": depth, "end": (outside & (depth == deepest if deepest == 1 else depth <= deepest)).cast("int")})

    ends = F.when(F.col("end") == 1, F.col("id"))
    held = tabled(placed(ranges).groupBy(*RANGE, "begins", "base", "left").agg(F.sum("end").alias("n_ends"), F.min(ends).alias("first"), F.max(ends).alias("last")))
    held = tabled(held.withColumn("ahead", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0))))
    rows = placed(held)
    inner = (F.col("id") > F.col("first")) & (F.col("id") <= F.col("last"))
    told_of = [F.max("end").alias("end"), F.max(F.when(F.col("end") == 1, F.col("depth"))).alias("ends"), F.sum("change").alias("change"), F.min("left").alias("left")]
    mine = rows.where(inner).withColumn("n", 1 + F.coalesce(F.sum("end").over(before), F.lit(0)))
    mine = mine.groupBy(*RANGE, "ahead", "n").agg(_joined("text", "id"), *told_of).withColumn("row", (F.col("ahead") + F.col("n")).cast("int"))
    # up to the first end of a range, and from its last one on
    place = F.when(F.col("id") > F.col("last"), F.col("ahead") + F.col("n_ends")).otherwise(F.col("ahead")).cast("int")
    across = rows.where(F.coalesce(~inner, F.lit(True))).groupBy("path", place.alias("row")).agg(_joined("text", "block", "id"), *told_of)
    columns = ["path", "row", "text", "end", "ends", "change", "left"]
    whole = mine.select(*columns).unionByName(across.select(*columns))
    return whole.withColumn("begins", F.col("ends") - F.col("change")).drop("change"), told


def elements(pieces: DataFrame) -> DataFrame:
    """path, row (an element's place in its file, from 0) and element (its text) of each element."""
    # at the end of an array there is no brace, which the last piece is taken to have
    whole = _stretches(pieces, 1)[0].withColumn("shut", F.col("left") == -1)
    start = F.when(F.col("row") == 0, r"^[\s\x{FEFF}]*\[\s*").otherwise(r"^\s*,\s*")
    own = F.regexp_replace("text", start, F.lit(""))
    object_ = F.col("shut") & (F.col("end") == 1) & own.startswith("{") & F.rlike(F.col("text"), start)
    rest = F.col("shut") & (F.col("end") == 0) & F.when(F.col("row") == 0, F.col("text").rlike(r"^[\s\x{FEFF}]*\[\s*\]\s*$")).otherwise(F.col("text").rlike(r"^\s*\]\s*$"))
    text = F.when(object_, F.concat(own, F.lit("}"))).when(~rest, F.raise_error(F.concat(F.lit("not a JSON array: "), "path")).cast("string"))
    return whole.select("path", "row", text.alias("element")).where("element IS NOT NULL")


#: Up to the first opening brace outside strings.
_AHEAD = r'(?s)^((?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+)'


def document(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files that are one JSON object each: the entries of its arrays of objects (path, field, pos, element: text), and path and value of what is left,
    a document whose arrays of objects are empty.

    An array's entries end at depth 2, as what a header's object holds does: an array is told by its name before its bracket, on the document's own level.
    Another kind of file is an error when rows are read, and so is an array of objects and other values."""
    whole, told = _stretches(pieces, 2)
    shut = F.col("left").isin(0, -1)  # with or without white space behind the last brace
    whole = whole.withColumn("text", F.when(shut, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), "path")).cast("string")))
    own = F.when(F.col("row") == 0, F.regexp_replace("text", r"^[\s\x{FEFF}]*\{", "")).otherwise(F.col("text"))
    rows = whole.withColumn("own", own).withColumn("goes_on", (F.col("begins") == 2) & F.col("text").rlike(r"^\s*,\s*\{"))
    level = (F.col("row") == 0) | (F.col("begins") <= 1) | F.col("text").rlike(r"^\s*\]")
    rows = rows.withColumn("ahead", F.when(F.col("goes_on"), "").otherwise(F.regexp_extract("own", _AHEAD, 1)))
    opens = level & ~F.col("goes_on") & (F.col("ends") == 2) & F.col("ahead").rlike(r'"[^"\\]*"\s*:\s*\[\s*$')
    rows = tabled(rows.select("path", "row", "end", "goes_on", "ahead", "own", F.when(opens, F.regexp_extract("ahead", r'"([^"\\]*)"\s*:\s*\[\s*$', 1)).alias("field")))
    discard(told)
    others = rows.where(~F.col("goes_on")).select("path", "row", "field")  # as many as a header has objects
    held = others.withColumn("upto", F.lead("row").over(Window.partitionBy("path").orderBy("row"))).where("field IS NOT NULL").select(F.col("path").alias("__path"), F.col("row").alias("__from"), "upto", "field")
    met = (F.col("path") == F.col("__path")) & (F.col("row") >= F.col("__from")) & (F.col("row") < F.coalesce("upto", F.lit(2**31 - 1)))
    rows = rows.drop("field").join(F.broadcast(held), met, "left")
    entry = F.col("field").isNotNull()
    text = F.when(F.col("goes_on"), F.regexp_replace("own", r"^\s*,\s*", "")).otherwise(F.expr("substring(own, length(ahead) + 1)"))
    entries = rows.where(entry).select("path", "field", (F.col("row") - F.col("__from")).alias("pos"), F.concat(text, F.lit("}")).alias("element"))
    brace = F.when(F.col("row") == 0, "{").otherwise("")
    rest = F.when(entry, F.concat(brace, "ahead")).otherwise(F.concat(brace, "own", F.when(F.col("end") == 1, "}").otherwise("")))
    left = rows.where(~F.col("goes_on") | ~entry).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", rest.alias("rest")))), lambda x: x["rest"]), "").alias("value"))
    return entries, left


def _joined(text: str, *order: str) -> Column:
    """Texts in order, with the braces between them."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "}").alias(text)
