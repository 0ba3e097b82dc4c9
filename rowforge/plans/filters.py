"""Projections, predicates and joins by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.formats import add_context
from ..operators import docquery as dq
from ..operators.features import UNUSED_COLUMNS, drop_columns, family_size, is_alone
from ..operators.health import diff_names, missing_required
from ..operators.preparation import (
    MAX_SMALL_CATEGORIES,
    Preparation,
    encode_lookup,
    fit_categories,
)
from ..operators.evaluate import pair_label_prediction
from ..operators.requests import log_tail_filter, slow_predictions, slow_requests
from ..operators.statistics import value_counts
from ..operators.validate import required_fields, schema_constraints
from ..functions.formats import iso_utc
from ..session import durable
from ..sources.tables import Tables
from .common import linear_scores, part_documents, word_documents
from .registry import FITTED, PASSENGERS, PREPARED, REQUESTS, SCORED, WORDS, query


@query("drop_columns", PASSENGERS + "select * from passengers")
def drop_columns_plan(t: Tables) -> DataFrame:
    raw = add_context(t.passengers, "x", "y", "z").withColumnsRenamed(
        {"service": "name", "version": "ticket", "environment": "home.dest"}
    )
    return drop_columns(raw, UNUSED_COLUMNS)


@query(
    "select_features",
    PREPARED
    + """select pclass, sex, age, sibsp, parch, fare, embarked, family_size, is_alone, age_group
       from prepared""",
)
def select_features_plan(t: Tables) -> DataFrame:
    return Preparation().fit(t.passengers).features(t.passengers)


@query("select_fields", "select cast(p_partkey as varchar) as id, p_name, p_size from part")
def select_fields_plan(t: Tables) -> DataFrame:
    return dq.doc_query(part_documents(t), select=["p_name", "p_size"])


@query(
    "select_nested_field",
    """select cast(event_id as varchar) as id, event_type,
       cast(json_extract_string(props, '$.k') as int) as k from events""",
)
def select_nested_field_plan(t: Tables) -> DataFrame:
    events = t["events"].select(
        F.col("event_id").cast("string").alias("id"),
        "event_type",
        F.from_json("props", "k int").alias("props"),
    )
    picked = dq.doc_query(events, select=["event_type", "props.k"])
    return picked.withColumnRenamed("props.k", "k")


@query(
    "derive_family_size",
    PASSENGERS + "select passenger_id, sibsp + parch + 1 as family_size from passengers",
)
def derive_family_size_plan(t: Tables) -> DataFrame:
    return t.passengers.select("passenger_id", family_size().alias("family_size"))


@query(
    "derive_is_alone",
    PASSENGERS
    + """select passenger_id, case when sibsp + parch + 1 = 1 then 1 else 0 end as is_alone
       from passengers""",
)
def derive_is_alone_plan(t: Tables) -> DataFrame:
    return t.passengers.select("passenger_id", is_alone(family_size()).alias("is_alone"))


@query(
    "where_compare",
    PASSENGERS
    + """select passenger_id, coalesce(age = 29, false) as eq, coalesce(age <> 29, false) as ne,
         coalesce(age < 29, false) as lt, coalesce(age <= 29, false) as le,
         coalesce(age > 29, false) as gt, coalesce(age >= 29, false) as ge,
         age is null as eq_null, age is not null as ne_null, false as text_match
       from passengers""",
)
def where_compare_plan(t: Tables) -> DataFrame:
    df = t.passengers
    names = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    sure = lambda column: F.coalesce(column, F.lit(False))
    return df.select(
        "passenger_id",
        *[sure(dq.where_compare(df, "age", op, 29)).alias(name) for name, op in names.items()],
        dq.where_compare(df, "age", "==", None).alias("eq_null"),
        dq.where_compare(df, "age", "!=", None).alias("ne_null"),
        dq.where_compare(df, "age", "==", "29").alias("text_match"),
    )


@query(
    "where_in",
    PASSENGERS + "select passenger_id, embarked from passengers where embarked in ('C', 'Q')",
)
def where_in_plan(t: Tables) -> DataFrame:
    df = t.passengers
    return df.where(dq.clause(df, "embarked", "in", ["C", "Q", None])).select(
        "passenger_id", "embarked"
    )


@query(
    "where_not_in",
    PASSENGERS
    + """select passenger_id, embarked from passengers
       where embarked is not null and embarked not in ('C', 'Q')""",
)
def where_not_in_plan(t: Tables) -> DataFrame:
    df = t.passengers
    return df.where(dq.clause(df, "embarked", "not-in", ["C", "Q"])).select(
        "passenger_id", "embarked"
    )


@query("where_array_contains", f"select doc_id from documents where list_contains({WORDS}, 'the')")
def where_array_contains_plan(t: Tables) -> DataFrame:
    return dq.doc_query(word_documents(t), where=[("words", "array-contains", "the")]).select(
        "doc_id"
    )


@query(
    "where_array_contains_any",
    f"select doc_id from documents where list_has_any({WORDS}, ['the', 'les', 'der'])",
)
def where_array_contains_any_plan(t: Tables) -> DataFrame:
    clause = ("words", "array-contains-any", ["the", "les", "der"])
    return dq.doc_query(word_documents(t), where=[clause]).select("doc_id")


@query(
    "word_search",
    f"select doc_id from documents where list_has_any({WORDS}, ['that', 'ein'])",
)
def word_search_plan(t: Tables) -> DataFrame:
    from ..functions.text import word_search

    return t.spread["documents"].where(word_search(F.col("text"), ["that", "EIN"])).select("doc_id")


@query(
    "where_and",
    """select cast(p_partkey as varchar) as id, p_size, p_retailprice from part
       where p_size >= 10 and p_size < 30 and p_retailprice > 950 and p_brand <> 'Brand#2'""",
)
def where_and_plan(t: Tables) -> DataFrame:
    clauses = [
        ("p_size", ">=", 10),
        ("p_size", "<", 30),
        ("p_retailprice", ">", 950),
        ("p_brand", "!=", "Brand#2"),
    ]
    return dq.doc_query(part_documents(t), where=clauses, select=["p_size", "p_retailprice"])


@query(
    "where_composite",
    """select cast(p_partkey as varchar) as id, p_size, p_type from part
       where p_size = 7 or p_type = 'ECONOMY' or p_retailprice < 910""",
)
def where_composite_plan(t: Tables) -> DataFrame:
    group = ("OR", [("p_size", "==", 7), ("p_type", "==", "ECONOMY"), ("p_retailprice", "<", 910)])
    return dq.doc_query(part_documents(t), composite=group, select=["p_size", "p_type"])


@query("where_unary", PASSENGERS + "select passenger_id from passengers where age is null")
def where_unary_plan(t: Tables) -> DataFrame:
    return dq.doc_query(t.passengers, unary=("age", "IS_NULL"), id_col="passenger_id").select(
        "passenger_id"
    )


@query(
    "filter_precedence",
    PASSENGERS + "select passenger_id, embarked, fare from passengers where fare is not null",
)
def filter_precedence_plan(t: Tables) -> DataFrame:
    options = {
        "where": [{"field": "pclass", "operator": "==", "value": 1}],
        "compositeFilter": {
            "op": "AND",
            "filters": [{"field": "embarked", "operator": "==", "value": "C"}],
        },
        "unaryFilter": {"field": "fare", "op": "IS_NOT_NULL"},
        "select": ["embarked", "fare"],
    }
    return dq.from_options(t.passengers, options, id_col="passenger_id")


@query(
    "where_cli_string",
    """select cast(p_partkey as varchar) as id, p_brand = 'Brand#2' as brand_match,
       false as size_as_text, cast(p_size as varchar) = '15' as size_coerced from part""",
)
def where_cli_string_plan(t: Tables) -> DataFrame:
    df = part_documents(t)
    return df.select(
        "id",
        dq.where_cli_string(df, "p_brand , == , Brand#2").alias("brand_match"),
        dq.where_cli_string(df, "p_size,==,15").alias("size_as_text"),
        dq.where_cli_string(df, "p_size,==,15", coerce=True).alias("size_coerced"),
    )


@query(
    "drop_empty_results",
    "select event_id, event_type, value from events where event_type <> 'error'",
)
def drop_empty_results_plan(t: Tables) -> DataFrame:
    found = F.when(F.col("event_type") != "error", F.struct("event_id", "event_type", "value"))
    results = t["events"].select(found.alias("document"))
    return dq.drop_empty_results(results).select("document.*")


@query(
    "required_fields",
    PASSENGERS
    + """select passenger_id, concat_ws(',', case when age is null then 'age' end,
         case when fare is null then 'fare' end,
         case when embarked is null then 'embarked' end) as missing_fields
       from passengers""",
)
def required_fields_plan(t: Tables) -> DataFrame:
    df = t.passengers
    missing = F.array_join(required_fields(df), ",")
    return df.select("passenger_id", missing.alias("missing_fields"))


@query(
    "schema_constraints",
    PASSENGERS
    + """select passenger_id, concat_ws(',', case when age is null then 'age' end,
         case when fare is null then 'fare' end,
         case when embarked is null then 'embarked' end) as broken
       from passengers""",
)
def schema_constraints_plan(t: Tables) -> DataFrame:
    df = t.passengers
    return df.select("passenger_id", F.array_join(schema_constraints(df), ",").alias("broken"))


@query(
    "slow_requests",
    REQUESTS
    + """select request_id, endpoint, cast(printf('%.2f', duration_ms) as double) as duration_ms
       from requests where duration_ms > 100""",
)
def slow_requests_plan(t: Tables) -> DataFrame:
    return slow_requests(t.requests).select("request_id", "endpoint", "duration_ms")


@query(
    "slow_predictions",
    REQUESTS
    + """select request_id, user_id, cast(printf('%.2f', duration_ms) as double) as duration_ms,
       duration_ms > 1000 as models_lazy_loaded from requests where duration_ms > 200""",
)
def slow_predictions_plan(t: Tables) -> DataFrame:
    return slow_predictions(t.requests).select(
        "request_id", "user_id", "duration_ms", "models_lazy_loaded"
    )


def log_lines(df: DataFrame) -> DataFrame:
    """Requests as lines of a platform log."""
    return df.select(
        iso_utc(F.col("ts")).alias("timestamp"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"),
        F.col("props").alias("text_payload"),
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("zone-"), F.col("user_id") % 4).alias("location"),
    )


@query(
    "log_tail_filter",
    """select strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp, 'info' as severity,
       props as text_payload from events
       where event_type = 'purchase' and user_id % 4 = 1""",
)
def log_tail_filter_plan(t: Tables) -> DataFrame:
    return log_tail_filter(log_lines(t["events"]), "purchase", "zone-1")


# ----------------------------------------------------------------------- joins


@query(
    "encode_lookup",
    """with codes as (
         select p_brand as category, cast(row_number() over (order by p_brand) - 1 as int) as code
         from (select distinct p_brand from part))
       select p_partkey, code as p_brand from part left join codes on p_brand = category""",
)
def encode_lookup_plan(t: Tables) -> DataFrame:
    part = t["part"].select("p_partkey", "p_brand")
    table = durable(fit_categories(durable(value_counts(part, ["p_brand"]))))
    small = table.count() <= MAX_SMALL_CATEGORIES
    return encode_lookup(part, table, "p_brand", unseen_to_first=False, small=small)


@query("apply_stats", FITTED + "select passenger_id, age, fare, embarked from filled")
def apply_stats_plan(t: Tables) -> DataFrame:
    preparation = Preparation().fit(t.passengers)
    return preparation.impute(t.passengers).select("passenger_id", "age", "fare", "embarked")


@query(
    "missing_required",
    """select name from (values ('view'), ('click'), ('refund'), ('sign_out')) v(name)
       where name not in (select event_type from events)""",
)
def missing_required_plan(t: Tables) -> DataFrame:
    present = t["events"].select(F.col("event_type").alias("name"))
    return missing_required(t.spark, present, ["view", "click", "refund", "sign_out"])


@query(
    "diff_names",
    """select c_custkey as user_id from customer
       where c_custkey not in (select user_id from events)""",
)
def diff_names_plan(t: Tables) -> DataFrame:
    customers = t["customer"].select(F.col("c_custkey").alias("user_id"))
    return diff_names(customers, t["events"].select("user_id"))


@query(
    "pair_label_prediction",
    """select l.doc_id, quality as y_true, case when n_chars > 1000 then 1 else 0 end as y_pred
       from labels l join documents d on l.doc_id = d.doc_id""",
)
def pair_label_prediction_plan(t: Tables) -> DataFrame:
    guess = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    predicted = t["documents"].select("doc_id", guess.alias("guess"))
    return pair_label_prediction(t["labels"], predicted, "doc_id", "quality", "guess")


@query(
    "align_model_scores",
    SCORED + "select passenger_id, round(p1, 6) as p1, round(p2, 6) as p2 from scored",
)
def align_model_scores_plan(t: Tables) -> DataFrame:
    return linear_scores(t).select(
        "passenger_id", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2")
    )
