"""Readers of fact, table, text and index files, and detection of new or changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .facts import FACT_SCHEMA
from .tables import stored

# Files that the incremental scan considers, and the columns of a missing corpus index.
EXTENSIONS = ["json", "csv", "pdf", "xlsx", "txt"]
INDEX_COLUMNS = ["doc_id", "title", "doc_type", "file_path", "year", "department", "go_number", "issued_date", "status", "source", "notes"]


def facts_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of facts; missing fields are null. One large file is read by many tasks."""
    return json_array(spark, path, FACT_SCHEMA)


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the file before each row.

    Sums run inside the byte ranges that Spark reads, side by side; a range starts from the totals of those before it.
    """
    rows = rows.withColumn("__v", value)
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "block").agg(F.sum("__v").alias("__all"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "block", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__start"))
    summed = rows.withColumn("__sum", F.coalesce(F.sum("__v").over(inside), F.lit(0))).join(starts, ["file", "block"])
    return summed.withColumn(name, F.col("__start") + F.col("__sum")).drop("__v", "__sum", "__start")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, keyed, number, block, at, text``: the objects of JSON files that hold one array of objects each, or one object
    of such arrays (``keyed``). ``text`` begins with what stands between an object and the one before it.

    Files are split where Spark splits them, and rows at closing braces. Whether a row begins inside a string follows
    from the quotes before it, and how deep it is nested from the brackets outside strings, so both are prefix sums; an
    object ends at a brace that leads back to the depth of its array, and a third sum numbers the objects. An object
    may cross ranges.
    """
    read = spark.read.option("lineSep", "}").text(path)
    rows = stored(read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")), "json")
    first = rows.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("value"))
    kinds = first.select("file", F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("{").alias("keyed"))
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    side = lambda odd: F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    count = lambda text, some: F.length(text) - F.length(F.translate(text, some, ""))
    nested = lambda odd: count(side(odd), "{[") - count(side(odd), "]")
    begun = running(rows, F.size(parts) - 1, "quotes").withColumn("odd", F.col("quotes") % 2)
    # the brace that ends a row counts unless it stands in a string
    brace = (F.col("odd") + F.size(parts) - 1) % 2 == 0
    change = F.when(F.col("odd") == 0, nested(0)).otherwise(nested(1)) - F.when(brace, 1).otherwise(0)
    deep = running(begun.withColumn("change", change).withColumn("closes", brace), F.col("change"), "depth").join(kinds, "file")
    ends = deep.withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("change") == F.when(F.col("keyed"), 2).otherwise(1))).cast("int"))
    numbered = running(ends, F.col("ends"), "number")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    objects = numbered.groupBy("file", "keyed", "number").agg(F.max("ends").alias("whole"), F.min(F.struct("block", "at")).alias("from"), F.concat(F.array_join(pieces, "}"), F.lit("}")).alias("text"))
    return objects.where("whole = 1").select("file", "keyed", "number", "from.block", "from.at", "text")


STRING = r'"(?:[^"\\]++|\\.)*+"'
#: what may stand before an object of an array, and before one of an object of arrays: ends of arrays, keys, and commas
BEFORE = rf'^(?:{STRING}|[^{{"]++)*+'
BEFORE_KEYED = rf"^\s*\{{?(?:\s*\]?\s*,?\s*{STRING}\s*:\s*\[)*[\s,]*"
LAST_KEY = rf"(?s)({STRING})\s*:\s*\[[\s,]*$"


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The objects of JSON arrays, one array for each file, as rows in the order of files and objects (``json_objects``).

    Numbers, strings and other values among them are passed over, and arrays as long as they hold no objects. An empty
    file or array has no rows; an object that doesn't fit the schema has nulls.
    """
    return json_objects(spark, path).orderBy("file", "number").select(F.from_json(F.regexp_replace("text", BEFORE, ""), schema).alias("x")).select("x.*")


def json_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of JSON files: of an object of lists, each tagged with its key as source_document, or of a plain list.
    Rows have the order of files and items.

    An item bears its list's key, which stands before the first item of the list: the items with a key before them
    number the lists, by a prefix sum again.
    """
    found = stored(json_objects(spark, path), "items")
    plain = found.where("not keyed").select("file", "number", F.lit(None).cast("string").alias("source_document"), F.from_json(F.regexp_replace("text", BEFORE, ""), f"struct<{item}>").alias("i"))
    rest = F.regexp_replace("text", BEFORE_KEYED, "")
    key = F.nullif(F.regexp_extract(F.substr(F.col("text"), F.lit(1), F.length("text") - F.length(rest)), LAST_KEY, 1), F.lit(""))
    lists = running(found.where("keyed").select("file", "number", "block", "at", rest.alias("rest"), key.alias("key")), F.col("key").isNotNull().cast("int"), "before")
    lists = lists.withColumn("list", F.col("before") + F.col("key").isNotNull().cast("int"))
    names = lists.where("key is not null").select("file", "list", F.get(F.from_json(F.concat(F.lit("["), "key", F.lit("]")), "array<string>"), F.lit(0)).alias("source_document"))
    tagged = lists.join(names, ["file", "list"]).select("file", "number", "source_document", F.from_json("rest", f"struct<{item}>").alias("i"))
    return tagged.union(plain).orderBy("file", "number").select("source_document", "i.*")


def statistics_csv(spark: SparkSession, path: str) -> DataFrame:
    """``district, indicator, value, year`` from a CSV whose columns are found by words in their names."""
    from ..operators.filters import find_column

    raw = spark.read.csv(path, header=True)
    wanted = {"district": ["district", "dist", "region"], "indicator": ["indicator", "metric", "parameter", "variable"], "value": ["value", "count", "number", "total"], "year": ["year", "yr", "academic_year"]}
    kinds = {"value": "double", "year": "int"}
    found = {k: find_column(raw.columns, w) for k, w in wanted.items()}
    return raw.select(*[(F.col(f"`{c}`") if c else F.lit(None)).try_cast(kinds.get(k, "string")).alias(k) for k, c in found.items()])


def corpus_index(spark: SparkSession, path: str) -> DataFrame:
    """The CSV index of a corpus; an absent one is an empty frame of its columns."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.csv(path, header=True)
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in INDEX_COLUMNS))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """``key, hash`` of the known kinds of files under a folder, read in parallel by file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.where(kind.isin(EXTENSIONS)).select(F.col("path").alias("key"), F.md5("content").alias("hash"))


def changed(files: DataFrame, tracker: DataFrame) -> DataFrame:
    """Files whose key is unknown or whose hash differs from the tracker's."""
    return files.join(tracker.select("key", "hash"), ["key", "hash"], "left_anti")


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(n)


def text_sample(df: DataFrame, column: str, n: int = 1000) -> DataFrame:
    return df.select(F.substring(column, 1, n).alias(column))
