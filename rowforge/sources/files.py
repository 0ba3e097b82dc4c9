"""CSV tables, JSON array files, log lines and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.formats import bytes_in
from ..session import durable

CORRUPT = "_corrupt_record"

# The field names and types of the raw passenger file and of log events.
PASSENGER_CSV = T.StructType(
    [
        T.StructField("passenger_id", T.LongType()),
        T.StructField("pclass", T.IntegerType()),
        T.StructField("sex", T.StringType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("sibsp", T.IntegerType()),
        T.StructField("parch", T.IntegerType()),
        T.StructField("fare", T.DoubleType()),
        T.StructField("embarked", T.StringType()),
        T.StructField("survived", T.IntegerType()),
    ]
)
LOG_EVENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("http_method", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("prediction_result", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("auth_event_type", T.StringType()),
        T.StructField("auth_success", T.BooleanType()),
        T.StructField("auth_error_reason", T.StringType()),
        T.StructField("rate_limit_type", T.StringType()),
        T.StructField("rate_limit_exceeded", T.BooleanType()),
        T.StructField("current_count", T.LongType()),
        T.StructField("limit_threshold", T.LongType()),
        T.StructField("client_ip", T.StringType()),
    ]
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark can read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a path pattern, on any file system Spark can read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in system.globStatus(target) or [] if s.isDirectory()]


def file_state(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of a file, or of the files of a folder: changes when they do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = system.listStatus(target) if system.exists(target) else []
    return tuple(sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in listed))


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = system.listStatus(target) if system.exists(target) else []
    return [s.getPath().getName() for s in listed if not s.getPath().getName().startswith((".", "_"))]


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file; False if there is one of this name already."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        return False
    try:
        out = system.create(target, False)
    except Exception as error:  # another writer was faster
        if system.exists(target):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    source = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def require_paths(spark: SparkSession, paths: list[str]) -> None:
    missing = [path for path in paths if not path_exists(spark, path)]
    if missing:
        raise FileNotFoundError(f"required but not found: {', '.join(missing)}")


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Header CSV as a typed table. Types are inferred (a second pass) without a schema.

    The header decides which columns there are, so an optional column may be absent.
    """
    require_paths(spark, [path])
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    known = {f.name: f for f in schema.fields}
    names = spark.read.option("header", True).csv(path).columns
    present = [known.get(n, T.StructField(n, T.StringType())) for n in names]
    return reader.schema(T.StructType(present)).csv(path)


def scan_json_array(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool = True,
    check: bool = True,
) -> DataFrame:
    """Rows of JSON array files; each file must hold an array of objects, not empty.

    The check reads the files twice; ``check=False`` trusts them, for an import that was
    checked before.

    One pretty-printed array per file cannot be split, so many files of moderate size
    scale; with ``multi_line=False`` every line is an array and any file can be split.
    """
    require_paths(spark, [path])
    reader = spark.read.option("multiLine", multi_line)
    if schema is None:
        schema = reader.json(path).schema
    fields = [f for f in schema.fields if f.name != CORRUPT]
    if not check:
        return reader.schema(T.StructType(fields)).json(path)
    kept = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])

    start = F.substring(F.ltrim("value"), 1, 1)
    lines = spark.read.text(path).where(F.trim("value") != "")
    if multi_line:
        placed = lines.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            start.alias("start"),
        )
        first = F.min_by("start", F.struct("block", "line"))
        roots = placed.groupBy("file").agg(first.alias("root"))
    else:
        roots = lines.select(start.alias("root"))
    if not roots.where(F.col("root") != "[").isEmpty():
        raise ValueError(f"not a JSON array of objects: {path}")

    rows = reader.schema(kept).option("mode", "PERMISSIVE").json(path)
    # the reader wants one ordinary column next to the one for broken records
    present = F.count(F.col(f"`{fields[0].name}`")) if fields else F.count("*")
    state = rows.agg(
        F.count("*").alias("n"), F.count(CORRUPT).alias("bad"), present.alias("present")
    ).first()
    if state["bad"]:
        raise ValueError(f"{state['bad']} records are not valid objects: {path}")
    if not state["n"]:
        raise ValueError(f"empty array: {path}")
    return rows.drop(CORRUPT)


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, value``: the text of every item of JSON array files, whatever their
    lines; a file is read by as many tasks as it has splits. Records count from 1.

    The reader cuts at commas, of which those between two items matter. A comma is one of
    them if it lies in no text, and only the outer array is open there. Both follow from what
    came before: the number of quotes says whether a text is open, then brackets outside of
    texts are counted. Both are sums over the pieces of a file, taken inside each split and
    carried over by one row per split.
    """
    require_paths(spark, [path])
    # an escaped character is neither a quote nor a bracket
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value"),
        plain.alias("plain"),
        (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))).cast("long").alias("quotes"),
    )
    pieces = _carried(durable(pieces), "quotes")  # places must not change
    in_text = F.col("before") % 2 == 1
    outer = F.when(in_text, F.regexp_replace("plain", r'(?s)^[^"]*("|$)', "")).otherwise(F.col("plain"))
    outer = F.regexp_replace(outer, r'(?s)"[^"]*("|$)', "")
    opened = F.length(F.translate(outer, "]}", "")) - F.length(F.translate(outer, "[{", ""))
    pieces = pieces.select("file", "block", "place", "value", in_text.alias("in_text"), opened.cast("long").alias("opened"))
    pieces = _carried(pieces, "opened")
    # the first piece of a file starts its first item
    starts = (~F.col("in_text") & (F.col("before") <= 1)).cast("long").alias("starts")
    pieces = _carried(pieces.select("file", "block", "place", "value", starts), "starts")
    parts = F.sort_array(F.collect_list(F.struct("block", "place", "value")))
    return (
        pieces.withColumn("record", F.col("before") + F.col("starts"))
        .groupBy("file", "record")
        .agg(parts.alias("parts"))
        .select("file", "record", F.array_join("parts.value", ",").alias("value"))
    )


def _carried(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``before``: the sum of a column over all rows of a file ahead of a row."""
    totals = rows.groupBy("file", "block").agg(F.sum(name).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split
    totals = totals.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("carried"))
    here = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum(name).over(here), F.lit(0)))
    return summed.join(totals, ["file", "block"]).withColumn("before", F.col("inside") + F.col("carried")).drop("inside", "carried")


def scan_large_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON array files of any size and layout; each file must hold an array of
    objects, not empty. No file is read by one task alone (see ``json_array_records``)."""
    found = durable(json_array_records(spark, path))
    last = found.groupBy("file").agg(F.max("record").alias("last"))
    text = F.regexp_replace("value", r"(?s)^\s+|\s+$", "")
    items = found.join(last, "file").withColumns(
        {"text": text, "is_first": F.col("record") == 1, "is_last": F.col("record") == F.col("last")}
    )
    framed = (~F.col("is_first") | F.col("text").startswith("[")) & (~F.col("is_last") | F.col("text").endswith("]"))
    item = F.when(F.col("is_first"), F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text"))
    item = F.when(F.col("is_last"), F.regexp_replace(item, r"(?s)\]$", "")).otherwise(item)
    items = items.withColumns({"framed": framed, "item": F.regexp_replace(item, r"(?s)^\s+|\s+$", "")})
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = durable(
        items.select(
            "framed",
            (F.col("is_first") & F.col("is_last") & (F.col("item") == "")).alias("empty"),
            (F.col("item").startswith("{") & F.col("item").endswith("}")).alias("is_object"),
            F.from_json("item", kept, options).alias("row"),
        )
    )
    good = F.col("is_object") & F.col("row").isNotNull() & F.col("row")[CORRUPT].isNull()
    state = rows.agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("framed")).alias("open"),
        F.count_if("empty").alias("empty"),
        F.count_if(~good).alias("bad"),
    ).first()
    if state["open"]:
        raise ValueError(f"not a JSON array of objects: {path}")
    if state["empty"] or not state["n"]:
        raise ValueError(f"empty array: {path}")
    if state["bad"]:
        raise ValueError(f"{state['bad']} records are not valid objects: {path}")
    return rows.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])


def scan_log(spark: SparkSession, path: str, schema: T.StructType = LOG_EVENT) -> DataFrame:
    """JSON log lines as events."""
    require_paths(spark, [path])
    return spark.read.schema(schema).json(path)


def artifact_inventory(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """Required parts of a folder: present or not, files, bytes, MB, last change.

    A part may be a file or a folder of files; contents are not read.
    """
    wanted = spark.createDataFrame([(name,) for name in required], "name string")
    existing = [name for name in required if path_exists(spark, f"{folder}/{name}")]
    if existing:
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load([f"{folder}/{name}" for name in existing])
            .select("path", "length", "modificationTime")
        )
        tail = F.element_at(F.split("path", f"{folder.rstrip('/').split('/')[-1]}/"), -1)
        found = (
            listed.withColumn("name", F.substring_index(tail, "/", 1))
            .groupBy("name")
            .agg(
                F.count("*").alias("files"),
                F.sum("length").alias("size_bytes"),
                F.max("modificationTime").alias("modified"),
            )
        )
    else:
        found = spark.createDataFrame(
            [], "name string, files long, size_bytes long, modified timestamp"
        )
    return wanted.join(found, "name", "left").select(
        "name",
        F.col("files").isNotNull().alias("present"),
        "files",
        "size_bytes",
        bytes_in(F.col("size_bytes"), "mb").alias("size_mb"),
        "modified",
    )


def missing_artifacts(inventory: DataFrame) -> DataFrame:
    return inventory.where(~F.col("present")).select("name")
