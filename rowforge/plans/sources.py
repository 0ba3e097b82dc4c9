"""Scans, sinks and document changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.typed import encode_typed
from ..operators.docquery import preview
from ..operators.preparation import REQUIRED_STATS, Preparation
from ..operators.training import TrainingRun
from ..session import scratch_path
from ..sources import documents as docs
from ..sources.files import (
    PASSENGER_CSV,
    artifact_inventory,
    scan_csv,
    scan_json_array,
    scan_large_json_array,
    scan_log,
)
from ..sources.tables import Tables
from ..functions.redaction import to_sorted_json
from ..functions.formats import iso_utc
from .common import CODED, part_documents, trained
from .registry import FITTED, PASSENGERS, PREPARED, query


@query("scan_csv", PASSENGERS + "select * from passengers")
def scan_csv_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "passengers-csv")
    t.passengers.write.option("header", True).csv(path)
    return scan_csv(t.spark, path, PASSENGER_CSV)


@query(
    "scan_json_array",
    "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
)
def scan_json_array_plan(t: Tables) -> DataFrame:
    customer = t["customer"]
    path = scratch_path(t.spark, "customers-json")
    batched = docs.batch_number(customer, [F.col("c_custkey")])
    # one array of at most one import batch per line
    items = F.collect_list(F.struct(*customer.columns))
    batched.groupBy("batch").agg(F.to_json(items).alias("value")).select("value").write.text(path)
    return scan_json_array(t.spark, path, customer.schema, multi_line=False)


@query(
    "scan_large_json_array",
    "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
)
def scan_large_json_array_plan(t: Tables) -> DataFrame:
    """One array over many lines in every file, read in parts."""
    customer = t["customer"]
    path = scratch_path(t.spark, "customers-array")
    texts = customer.select(
        F.spark_partition_id().alias("part"),
        F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("c_custkey")).alias("nth"),
        F.to_json(F.struct(*customer.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"),
    )
    counted = texts.withColumn("of", F.count("*").over(Window.partitionBy("part")))
    opened = F.when(F.col("nth") == 1, "[").otherwise("")
    closed = F.when(F.col("nth") == F.col("of"), "]").otherwise(",")
    lines = counted.sortWithinPartitions("part", "nth").select("part", F.concat(opened, "value", closed).alias("value"))
    lines.write.partitionBy("part").text(path)
    return scan_large_json_array(t.spark, path, customer.schema)


@query(
    "scan_collection",
    """select cast(c_custkey as varchar) as id, c_custkey, c_name, c_nationkey, c_acctbal,
       c_mktsegment from customer""",
)
def scan_collection_plan(t: Tables) -> DataFrame:
    return docs.with_id(docs.scan_collection(t.spark, t.root, "customer.parquet"), "c_custkey")


@query(
    "scan_collection_raw",
    """select 'part/' || p_partkey as name, p_name as part_name, p_brand as brand,
       cast(p_size as varchar) as size_text,
       case when p_retailprice = floor(p_retailprice)
            then cast(cast(p_retailprice as bigint) as varchar) end as price_integer,
       case when p_retailprice <> floor(p_retailprice) then p_retailprice end as price_double
       from part""",
)
def scan_collection_raw_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "part-raw")
    docs.write_typed(encode_typed(t["part"], "p_partkey", "part"), path)
    fields = F.col("fields")
    return docs.scan_collection_raw(t.spark, path).select(
        "name",
        fields["p_name"]["stringValue"].alias("part_name"),
        fields["p_brand"]["stringValue"].alias("brand"),
        fields["p_size"]["integerValue"].alias("size_text"),
        fields["p_retailprice"]["integerValue"].alias("price_integer"),
        fields["p_retailprice"]["doubleValue"].alias("price_double"),
    )


def _customer_accounts(t: Tables) -> DataFrame:
    return t["customer"].select(
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
    )


def _nation_accounts(t: Tables) -> DataFrame:
    return t["nation"].select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.col("n_nationkey").alias("nationkey"),
    )


def _supplier_accounts(t: Tables) -> DataFrame:
    return t["supplier"].select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"),
    )


ACCOUNTS = """
select 'c' || c_custkey as id, c_name as name, c_nationkey as nationkey,
  c_acctbal as acctbal, c_mktsegment as segment from customer
union all
select 's' || s_suppkey, s_name, s_nationkey, s_acctbal, null from supplier"""


@query(
    "scan_collection_group",
    ACCOUNTS + " union all select 'n' || n_nationkey, n_name, n_nationkey, null, null from nation",
)
def scan_collection_group_plan(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "store")
    _customer_accounts(t).write.parquet(f"{root}/accounts")
    _supplier_accounts(t).write.parquet(f"{root}/partners/wholesale/accounts")
    deep = "/".join(f"level{i}/doc{i}" for i in range(7))
    _nation_accounts(t).write.parquet(f"{root}/{deep}/accounts")
    t["nation"].write.parquet(f"{root}/nations")
    return docs.scan_query(t.spark, root, "accounts", {"collectionGroup": True})


@query(
    "scan_catalogued_group",
    ACCOUNTS + " union all select 'n' || n_nationkey, n_name, n_nationkey, null, null from nation",
)
def scan_catalogued_group_plan(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "catalogued")
    docs.write_collection(_customer_accounts(t), root, "accounts")
    docs.write_collection(_supplier_accounts(t), root, "partners/wholesale/accounts")
    deep = "/".join(f"level{i}/doc{i}" for i in range(7))
    docs.write_collection(_nation_accounts(t), root, f"{deep}/accounts")
    docs.write_collection(t["nation"], root, "nations")
    return docs.scan_catalogued_group(t.spark, root, "accounts")


@query("union_collections", ACCOUNTS)
def union_collections_plan(t: Tables) -> DataFrame:
    return docs.union_collections(_customer_accounts(t), _supplier_accounts(t))


@query(
    "point_lookup",
    """select cast(p_partkey as varchar) as id, p_partkey, p_name, p_brand, p_type, p_size,
       p_retailprice from part where cast(p_partkey as varchar) = '42'""",
)
def point_lookup_plan(t: Tables) -> DataFrame:
    return docs.point_lookup(part_documents(t), "42", key="p_partkey")


def _read_import(t: Tables, path: str) -> DataFrame:
    return t.spark.read.parquet(path).select(
        "name",
        "nationkey",
        "acctbal",
        F.col("id").rlike("^[0-9a-f-]{36}$").alias("has_id"),
        F.col("importedAt").isNotNull().alias("has_import_time"),
    )


@query(
    "bulk_append",
    """select c_name as name, c_nationkey as nationkey, c_acctbal as acctbal,
         true as has_id, true as has_import_time from customer
       union all
       select s_name, s_nationkey, s_acctbal, true, true from supplier""",
)
def bulk_append_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "append")
    docs.bulk_append(_customer_accounts(t).drop("id", "segment"), path)
    docs.bulk_append(_supplier_accounts(t).drop("id"), path)
    return _read_import(t, path)


@query(
    "bulk_replace",
    """select s_name as name, s_nationkey as nationkey, s_acctbal as acctbal,
       true as has_id, true as has_import_time from supplier""",
)
def bulk_replace_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "replace")
    docs.bulk_append(_customer_accounts(t).drop("id", "segment"), path)
    docs.bulk_replace(_supplier_accounts(t).drop("id"), path)
    return _read_import(t, path)


@query(
    "batch_number",
    """select o_orderkey,
         cast(floor((row_number() over (order by o_orderkey) - 1) / 500) as bigint) + 1 as batch,
         cast(ceil(count(*) over () / 500) as bigint) as total_batches
       from orders""",
)
def batch_number_plan(t: Tables) -> DataFrame:
    return docs.batch_number(t["orders"].select("o_orderkey"), [F.col("o_orderkey")])


@query(
    "import_summary",
    """with batched as (
         select cast(floor((row_number() over (order by o_orderkey) - 1) / 500) as bigint) + 1 as batch,
           o_totalprice < 499500 as ok
         from orders)
       select batch,
         case when count(*) filter (not ok) = 0 then count(*) else 0 end as imported,
         case when count(*) filter (not ok) > 0 then count(*) else 0 end as failed
       from batched group by batch""",
)
def import_summary_plan(t: Tables) -> DataFrame:
    orders = t["orders"].select("o_orderkey", "o_totalprice")
    batched = docs.batch_number(orders, [F.col("o_orderkey")])
    return docs.import_summary(batched, F.col("o_totalprice") < 499500)


@query("doc_insert", ACCOUNTS)
def doc_insert_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "insert")
    _customer_accounts(t).write.parquet(path)
    stored = docs.doc_insert(t.spark.read.parquet(path), _supplier_accounts(t))
    target = scratch_path(t.spark, "inserted")
    docs.replace_collection(stored, target)
    return t.spark.read.parquet(target)


def _returned_parts(t: Tables) -> DataFrame:
    return (
        t["lineitem"]
        .where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.max("l_extendedprice").alias("p_retailprice"),
            F.count("*").alias("returns"),
        )
    )


@query(
    "doc_merge",
    """with u as (
         select l_partkey, max(l_extendedprice) as price, count(*) as returns
         from lineitem where l_returnflag = 'R' group by l_partkey)
       select p_partkey, p_name, p_brand, p_type,
         case when returns > 8 then null else p_size end as p_size,
         coalesce(price, p_retailprice) as p_retailprice
       from part left join u on p_partkey = l_partkey""",
)
def doc_merge_plan(t: Tables) -> DataFrame:
    # parts returned often lose their size: a null that is supplied
    price, size = F.lit("p_retailprice"), F.lit("p_size")
    updates = _returned_parts(t).select(
        "p_partkey",
        "p_retailprice",
        F.lit(None).cast("int").alias("p_size"),
        F.when(F.col("returns") > 8, F.array(price, size)).otherwise(F.array(price)).alias("given"),
    )
    return docs.doc_merge(t["part"], updates, "p_partkey", supplied="given")


@query(
    "doc_delete",
    """select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part
       where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)""",
)
def doc_delete_plan(t: Tables) -> DataFrame:
    keys = t["lineitem"].where(F.col("l_quantity") > 49).select(
        F.col("l_partkey").alias("p_partkey")
    )
    return docs.doc_delete(t["part"], keys, "p_partkey")


@query(
    "preview",
    """select o_orderkey, o_totalprice, o_orderstatus, (select count(*) from orders) - 5 as more
       from orders order by o_orderkey limit 5""",
)
def preview_plan(t: Tables) -> DataFrame:
    orders = t["orders"].select("o_orderkey", "o_totalprice", "o_orderstatus")
    return preview(orders, ["o_orderkey"], 5)


@query(
    "scan_log",
    """select cast(event_id as varchar) as request_id, event_type as endpoint,
         case when event_type = 'error' then 500 else 200 end as status_code,
         value as duration_ms, cast(user_id as varchar) as user_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp, 'INFO' as level
       from events""",
)
def scan_log_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "log")
    lines = t.requests.select(
        F.col("request_id").cast("string").alias("request_id"),
        "endpoint",
        "status_code",
        "duration_ms",
        F.col("user_id").cast("string").alias("user_id"),
        iso_utc(F.col("ts")).alias("timestamp"),
        F.lit("INFO").alias("level"),
    )
    lines.select(to_sorted_json(lines).alias("value")).write.text(path)
    return scan_log(t.spark, path).select(*lines.columns)


# ------------------------------------------------------------- stored state


@query(
    "save_prep_state",
    PREPARED
    + """select 'age_median' as name, age_median as dvalue, cast(null as varchar) as svalue from fitted
       union all select 'fare_median', fare_median, null from fitted
       union all select 'embarked_mode', null, embarked_mode from fitted
       union all select 'rows', count(*), null from passengers
       union all select 'code ' || code, null, 'sex ' || category from sex_codes
       union all select 'code ' || code, null, 'embarked ' || category from port_codes
       union all select 'feature ' || pos, null, name from (values (0, 'pclass'), (1, 'sex'), (2, 'age'),
         (3, 'sibsp'), (4, 'parch'), (5, 'fare'), (6, 'embarked'), (7, 'family_size'), (8, 'is_alone'),
         (9, 'age_group')) f(pos, name)""",
)
def save_prep_state_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "prep")
    Preparation().fit(t.passengers).save(t.spark, path)
    none = F.lit(None)
    stats = t.spark.read.parquet(f"{path}/stats").where(F.col("name").isin([*REQUIRED_STATS, "rows"]))
    codes = t.spark.read.parquet(f"{path}/encodings").select(
        F.concat(F.lit("code "), "code"), none.cast("double"), F.concat_ws(" ", "column", "category")
    )
    features = t.spark.read.parquet(f"{path}/feature_columns").select(
        F.concat(F.lit("feature "), "pos"), none.cast("double"), "name"
    )
    return stats.select("name", "dvalue", "svalue").union(codes).union(features)


@query("load_prep_state", PREPARED + "select * from prepared")
def load_prep_state_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "prep")
    Preparation().fit(t.passengers).save(t.spark, path)
    return Preparation.load(t.spark, path).transform(t.passengers).select(*CODED)


def _saved_run(t: Tables) -> str:
    path = scratch_path(t.spark, "models")
    trained(t).save(t.spark, path)
    return path


@query(
    "save_models",
    """select model, true as same_accuracy
       from (values ('logistic_regression'), ('decision_tree'), ('ensemble')) m(model)""",
)
def save_models_plan(t: Tables) -> DataFrame:
    """The stored accuracies, read back, against those measured."""
    measured = list(trained(t).accuracies.items())
    wanted = t.spark.createDataFrame(measured, "model string, wanted double")
    stored = t.spark.read.parquet(f"{_saved_run(t)}/evaluation_results")
    same = (F.col("accuracy") == F.col("wanted")).alias("same_accuracy")
    return stored.join(wanted, "model", "left").select("model", same)


@query("load_models", PASSENGERS + "select passenger_id, true as same_scores from passengers")
def load_models_plan(t: Tables) -> DataFrame:
    first, again = trained(t), TrainingRun.load(t.spark, _saved_run(t))
    before = first.models.predict_proba(first.preparation.transform(t.passengers))
    renamed = before.withColumnsRenamed({"lr_prob": "lr_before", "dt_prob": "dt_before"})
    after = again.models.predict_proba(renamed.drop("lr_label", "dt_label"))
    same = (F.col("lr_before") == F.col("lr_prob")) & (F.col("dt_before") == F.col("dt_prob"))
    return after.select("passenger_id", same.alias("same_scores"))


@query(
    "artifact_inventory",
    """select name, present, present as has_files, present as sized, present as dated
       from (values ('stats', true), ('encodings', true), ('feature_columns', true),
       ('logistic_model', false)) v(name, present)""",
)
def artifact_inventory_plan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "prep")
    Preparation().fit(t.passengers).save(t.spark, path)
    required = ["stats", "encodings", "feature_columns", "logistic_model"]
    found = artifact_inventory(t.spark, path, required)
    size, mb = F.col("size_bytes"), F.col("size_mb")
    recent = F.abs(F.unix_timestamp() - F.unix_timestamp("modified")) < 3600
    return found.select(
        "name",
        "present",
        F.coalesce(F.col("files") > 0, F.lit(False)).alias("has_files"),
        F.coalesce((size > 0) & (F.abs(mb - size / 1024 / 1024) < 0.01), F.lit(False)).alias("sized"),
        F.coalesce(recent, F.lit(False)).alias("dated"),
    )
