"""Collections of documents: scans, lookups, imports and changes.

A collection is a parquet folder. Changes return the new state of a collection as a
DataFrame, which ``replace_collection`` writes to another folder: Spark cannot overwrite
the files it is reading.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.typed import DOCUMENT, document_type, unwrap_documents
from ..operators.ranking import global_index
from .files import create_text, list_folders, path_exists

# Fixed value: rows of one import batch.
BATCH_SIZE = 500


class DocumentNotFound(KeyError):
    """There is no document with this id."""


class ImportFailed(RuntimeError):
    """Not a single batch was imported."""


def with_id(df: DataFrame, key: str | Column) -> DataFrame:
    """The rows as documents: ``id`` as text in front."""
    column = F.col(key) if isinstance(key, str) else key
    return df.select(column.cast("string").alias("id"), *df.columns)


# ------------------------------------------------------------------------ scans


def scan_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def scan_collection_raw(spark: SparkSession, path: str) -> DataFrame:
    """Documents with typed fields and their times, from JSON lines."""
    return spark.read.schema(DOCUMENT).json(path)


def scan_collection_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Plain rows of typed documents: each line is parsed once, and only the fields of
    ``schema`` are taken from it."""
    return unwrap_documents(spark.read.schema(document_type(schema)).json(path), schema)


def get_document_raw(raw: DataFrame, name: str) -> DataFrame:
    return point_lookup(raw, name, "name")


def collection_paths(spark: SparkSession, root: str, name: str) -> list[str]:
    """Folders of all collections of a name: at the root, or below any document at any
    depth. Only folders are listed, one level of documents at a time."""
    found, above = [], f"{root}"
    while True:
        found += [p for p in list_folders(spark, f"{above}/{name}")]
        above = f"{above}/*/*"
        if not list_folders(spark, above):
            return sorted(found)


def scan_collection_group(
    spark: SparkSession, root: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    """All collections of this name, at the root or under any document.

    With ``schema`` no footer is read; without it the schemas of all files are merged.
    """
    paths = collection_paths(spark, root, name)
    if not paths and schema is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    return reader.parquet(*(paths or [f"{root}/{name}"]))


# Fixed value: the folder of a root that says which collections there are.
CATALOGUE = "_catalogue"


def register_collection(spark: SparkSession, root: str, path: str, schema: T.StructType) -> None:
    """Notes a collection (``path`` below the root) and its schema; again with another
    schema, the note is of the fields of both."""
    name = path.rstrip("/").split("/")[-1]
    entry = json.dumps({"path": path.strip("/"), "schema": schema.json()}, sort_keys=True)
    # the same note has the same name, so writing it twice is no harm
    note = f"{root}/{CATALOGUE}/{name}/{hashlib.md5(entry.encode()).hexdigest()}.json"
    create_text(spark, note, entry)


def write_collection(df: DataFrame, root: str, path: str, mode: str = "append") -> None:
    """Writes documents to a collection and notes it."""
    df.write.mode(mode).parquet(f"{root}/{path}")
    register_collection(df.sparkSession, root, path, df.schema)


def scan_catalogued_group(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All noted collections of a name, wherever they are: one listing, however deep they
    lie, and no footer read. A field that a collection lacks is null there."""
    folder = f"{root}/{CATALOGUE}/{name}"
    if not path_exists(spark, folder):
        raise FileNotFoundError(f"no collection of this name is noted: {name}")
    notes = spark.read.schema("path string, schema string").json(folder)
    schemas = [T.StructType.fromJson(json.loads(r["schema"])) for r in notes.select("schema").distinct().collect()]
    fields: dict[str, T.StructField] = {}
    for field in (f for schema in schemas for f in schema.fields):
        known = fields.setdefault(field.name, T.StructField(field.name, field.dataType))
        if known.dataType != field.dataType:
            raise ValueError(f"{field.name} is {known.dataType.simpleString()} and {field.dataType.simpleString()}")
    paths = sorted(r["path"] for r in notes.select("path").distinct().collect())
    merged = T.StructType([fields[n] for n in sorted(fields)])
    return spark.read.schema(merged).parquet(*[f"{root}/{p}" for p in paths])


def scan_query(spark: SparkSession, root: str, name: str, options: dict) -> DataFrame:
    """What the option object of a document client reads: one collection, or with
    ``collectionGroup`` all collections of the name."""
    if options.get("collectionGroup"):
        return scan_collection_group(spark, root, name)
    return scan_collection(spark, root, name)


def union_collections(*frames: DataFrame) -> DataFrame:
    """Same-named collections as one; a field one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def point_lookup(
    df: DataFrame, doc_id: str, id_col: str = "id", key: str | None = None
) -> DataFrame:
    """The document of an id, as a frame of one row or none.

    ``key`` names the column that the id is the text of: compared in its own type it
    reaches the scan, which a computed text does not.
    """
    wanted = F.col(id_col) == doc_id
    if key:
        wanted = (F.col(key) == F.lit(doc_id).try_cast(df.schema[key].dataType)) & wanted
    return df.where(wanted).limit(1)


def get_document(df: DataFrame, doc_id: str, id_col: str = "id", strict: bool = True):
    """The row of an id; absent it is an error, or None when not ``strict``."""
    row = point_lookup(df, doc_id, id_col).first()
    if row is None and strict:
        raise DocumentNotFound(doc_id)
    return row


# ---------------------------------------------------------------------- imports


def import_rows(df: DataFrame) -> DataFrame:
    """Rows with a generated id and the time of the import."""
    return df.withColumn("id", F.expr("uuid()")).withColumn("importedAt", F.current_timestamp())


def bulk_append(df: DataFrame, path: str) -> None:
    import_rows(df).write.mode("append").parquet(path)


def bulk_replace(df: DataFrame, path: str) -> None:
    """Clear the collection, then import."""
    import_rows(df).write.mode("overwrite").parquet(path)


def batch_number(df: DataFrame, order: list[Column], size: int = BATCH_SIZE) -> DataFrame:
    """1-based batch of each row in the given total order, and the number of batches."""
    indexed = global_index(df, order, "__index")
    total = F.ceil(indexed.select(F.count("*")).scalar() / size)
    return indexed.withColumns(
        {
            "batch": F.floor(F.col("__index") / size) + 1,
            "total_batches": total.cast("long"),
        }
    ).drop("__index")


def import_summary(batched: DataFrame, is_valid: Column, batch: str = "batch") -> DataFrame:
    """Rows imported and refused per batch; one bad row refuses its whole batch."""
    rows, bad = F.count("*"), F.count_if(~is_valid)
    return batched.groupBy(batch).agg(
        F.when(bad == 0, rows).otherwise(0).alias("imported"),
        F.when(bad > 0, rows).otherwise(0).alias("failed"),
    )


def require_imported(summary: DataFrame) -> int:
    """Number of imported rows; none at all is an error."""
    imported = summary.agg(F.sum("imported")).first()[0] or 0
    if not imported:
        raise ImportFailed("no document was imported")
    return imported


# ---------------------------------------------------------------------- changes


def doc_insert(df: DataFrame, new: DataFrame) -> DataFrame:
    """The collection with the new documents."""
    return df.unionByName(new, allowMissingColumns=True)


def latest_update(updates: DataFrame, id_col: str, seq: str) -> DataFrame:
    """The last update of each id, where an id was updated several times."""
    fields = [c for c in updates.columns if c != id_col]
    last = F.max_by(F.struct(*fields), F.col(seq))
    return updates.groupBy(id_col).agg(last.alias("__last")).select(id_col, "__last.*").drop(seq)


def doc_merge(
    df: DataFrame,
    updates: DataFrame,
    id_col: str = "id",
    supplied: str | None = None,
    replace: bool = False,
    upsert: bool = False,
) -> DataFrame:
    """Set the supplied fields of existing documents and keep the others.

    ``supplied`` names an array column with the fields an update carries, so that a
    supplied null overwrites; without it every non-null field is supplied. ``replace``
    drops the fields an update does not carry. ``upsert`` also adds unknown ids. There
    must be one update per id (see ``latest_update``).
    """
    fields = [c for c in updates.columns if c not in (id_col, supplied)]
    names = [id_col, *[c for c in df.columns if c != id_col]]
    names += [c for c in fields if c not in names]
    old = df.alias("old")
    new = updates.withColumn("__hit", F.lit(True)).alias("new")
    joined = old.join(
        new, F.col(f"old.{id_col}") == F.col(f"new.{id_col}"), "full" if upsert else "left"
    )
    merged = [F.coalesce(F.col(f"old.{id_col}"), F.col(f"new.{id_col}")).alias(id_col)]
    for name in names[1:]:
        before = F.col(f"old.{name}") if name in df.columns else F.lit(None)
        if name not in fields:
            value = F.when(F.col("new.__hit").isNull(), before) if replace else before
        else:
            after = F.col(f"new.{name}")
            given = F.array_contains(f"new.{supplied}", name) if supplied else after.isNotNull()
            given = F.coalesce(given, F.lit(False))
            if replace:
                value = F.when(F.col("new.__hit").isNull(), before).when(given, after)
            else:
                value = F.when(given, after).otherwise(before)
        merged.append(value.alias(name))
    return joined.select(*merged)


def doc_delete(df: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """The collection without the documents of these ids."""
    # distinct keys leave the map side once each, and stay where the join wants them
    return df.join(keys.select(id_col).distinct(), id_col, "left_anti")


def replace_collection(df: DataFrame, path: str) -> None:
    """Write a changed collection; ``path`` must not be one the frame reads from."""
    df.write.mode("overwrite").parquet(path)


# ------------------------------------------------------------------ typed lines


def write_typed(documents: DataFrame, path: str) -> None:
    """JSON document texts (column ``value``) as lines."""
    documents.select(F.col("value").cast(T.StringType())).write.mode("overwrite").text(path)
