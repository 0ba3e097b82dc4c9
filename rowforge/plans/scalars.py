"""Cleaning, coercion, feature and score functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import formats, numbers, scores
from ..functions.text import normalize_case
from ..operators import health
from ..operators.features import age_group, age_group_legacy, make_passenger_rows
from ..operators.preparation import Preparation
from ..operators.validate import detect_anomalies, validate_params, validate_rows, web_validate
from ..sources.tables import Tables
from .common import linear_scores
from .registry import AGE_GROUP, FITTED, PASSENGERS, PREPARED, SCORED, query


@query("impute", FITTED + "select passenger_id, age, fare, embarked from filled")
def impute_plan(t: Tables) -> DataFrame:
    preparation = Preparation().fit(t.passengers)
    return preparation.impute(t.passengers).select("passenger_id", "age", "fare", "embarked")


@query("age_group", PASSENGERS + f"select passenger_id, {AGE_GROUP} as age_group from passengers")
def age_group_plan(t: Tables) -> DataFrame:
    return t.passengers.select("passenger_id", age_group(F.col("age")).alias("age_group"))


@query(
    "age_group_legacy",
    PASSENGERS
    + f"select passenger_id, coalesce({AGE_GROUP}, -1) as age_group from passengers",
)
def age_group_legacy_plan(t: Tables) -> DataFrame:
    return t.passengers.select("passenger_id", age_group_legacy(F.col("age")).alias("age_group"))


@query("encode_known", PREPARED + "select passenger_id, sex, embarked from prepared")
def encode_known_plan(t: Tables) -> DataFrame:
    preparation = Preparation().fit(t.passengers)
    coded = preparation.encode(preparation.impute(t.passengers), unseen_to_first=False)
    return coded.select("passenger_id", "sex", "embarked")


@query(
    "encode_unseen",
    PASSENGERS
    + """select passenger_id, case when pclass = 3 then 0 when embarked = 'S' then 2
         when embarked = 'Q' then 1 else 0 end as embarked from passengers""",
)
def encode_unseen_plan(t: Tables) -> DataFrame:
    passengers = t.passengers
    preparation = Preparation().fit(passengers)
    port = F.when(F.col("pclass") == 3, "X").otherwise(F.col("embarked"))
    return preparation.encode(passengers.withColumn("embarked", port)).select(
        "passenger_id", "embarked"
    )


# ------------------------------------------------------------ numbers from text


def _spelled() -> Column:
    """Event values as the texts people type: padded, with a suffix, words, nothing."""
    value, kind = F.col("value").cast("string"), F.col("event_type")
    return (
        F.when(kind == "view", F.concat(F.lit("  "), value))
        .when(kind == "click", F.concat(value, F.lit("f")))
        .when(kind == "signup", F.lit("abc"))
        .when(kind == "error", F.lit(""))
        .otherwise(value)
    )


@query(
    "coerce_float",
    """select event_id, case when event_type in ('view', 'purchase') then value end as number
       from events""",
)
def coerce_float_plan(t: Tables) -> DataFrame:
    return t["events"].select("event_id", numbers.coerce_float(_spelled()).alias("number"))


@query(
    "coerce_int",
    """select event_id, case when event_type in ('view', 'purchase')
       then cast(trunc(value) as bigint) end as number from events""",
)
def coerce_int_plan(t: Tables) -> DataFrame:
    return t["events"].select("event_id", numbers.coerce_int(_spelled()).alias("number"))


@query(
    "parse_form_numbers",
    """select event_id,
         case when event_type in ('view', 'purchase', 'click') then value end as as_float,
         case when event_type in ('view', 'purchase', 'click') then trunc(value) end as as_int
       from events""",
)
def parse_form_numbers_plan(t: Tables) -> DataFrame:
    text = _spelled()
    nan_to_null = lambda column: F.nanvl(column, F.lit(None))
    return t["events"].select(
        "event_id",
        nan_to_null(numbers.parse_form_float(text)).alias("as_float"),
        nan_to_null(numbers.parse_form_int(text)).alias("as_int"),
    )


@query(
    "bounds_check",
    """select o_orderkey, o_totalprice / 400 <= 1000 as fare_ok,
         o_custkey % 150 <= 120 as age_ok, o_orderkey % 25 <= 20 as sibsp_ok from orders""",
)
def bounds_check_plan(t: Tables) -> DataFrame:
    return t["orders"].select(
        "o_orderkey",
        numbers.in_bounds(F.col("o_totalprice") / 400, "fare").alias("fare_ok"),
        numbers.in_bounds(F.col("o_custkey") % 150, "age").alias("age_ok"),
        numbers.in_bounds(F.col("o_orderkey") % 25, "sibsp").alias("sibsp_ok"),
    )


@query(
    "outlier_flag",
    """select o_orderkey, o_totalprice / 400 > 500 and o_totalprice / 400 <= 1000 as fare_outlier,
         o_custkey % 150 > 80 and o_custkey % 150 <= 120 as age_outlier,
         o_orderkey % 25 > 9 and o_orderkey % 25 <= 20 as parch_outlier from orders""",
)
def outlier_flag_plan(t: Tables) -> DataFrame:
    return t["orders"].select(
        "o_orderkey",
        numbers.is_outlier(F.col("o_totalprice") / 400, "fare").alias("fare_outlier"),
        numbers.is_outlier(F.col("o_custkey") % 150, "age").alias("age_outlier"),
        numbers.is_outlier(F.col("o_orderkey") % 25, "parch").alias("parch_outlier"),
    )


@query(
    "category_check",
    PASSENGERS
    + """select passenger_id, sex in ('male', 'female') as sex_ok,
         coalesce(embarked in ('C', 'Q', 'S'), false) as embarked_ok,
         pclass + 1 in (1, 2, 3) as class_ok from passengers""",
)
def category_check_plan(t: Tables) -> DataFrame:
    return t.passengers.select(
        "passenger_id",
        numbers.in_category(F.col("sex"), "sex").alias("sex_ok"),
        numbers.in_category(F.col("embarked"), "embarked").alias("embarked_ok"),
        numbers.in_category(F.col("pclass") + 1, "pclass").alias("class_ok"),
    )


# ------------------------------------------------------------------- validation

_RAW = (
    PASSENGERS
    + """, raw as (
  select passenger_id, pclass, case when sibsp = 3 then 'other' else sex end as sex,
    case when parch = 2 then age * 2 else age end as age, sibsp, parch,
    case when sibsp = 2 then -fare else fare end as fare, embarked
  from passengers)"""
)


def _raw(t: Tables) -> DataFrame:
    """Passengers with values that break rules: sexes, ages over 120, negative fares."""
    sibsp, fare = F.col("sibsp"), F.col("fare")
    return t.spread.passengers.withColumns(
        {
            "sex": F.when(sibsp == 3, "other").otherwise(F.col("sex")),
            "age": F.when(F.col("parch") == 2, F.col("age") * 2).otherwise(F.col("age")),
            "fare": F.when(sibsp == 2, -fare).otherwise(fare),
        }
    ).drop("survived")


@query(
    "web_validate",
    _RAW
    + """select passenger_id, concat_ws(',', case when age is null then 'age' end,
           case when fare is null then 'fare' end,
           case when embarked is null then 'embarked' end) as missing_fields,
         case when age is null or fare is null or embarked is null then null
           when age < 0 or age > 100 then 'Age must be between 0 and 100'
           when fare < 0 then 'Fare must be non-negative'
           when sex not in ('male', 'female') then 'Sex must be "male" or "female"'
         end as web_issue
       from raw""",
)
def web_validate_plan(t: Tables) -> DataFrame:
    checked = web_validate(_raw(t))
    return checked.select(
        "passenger_id", F.array_join("missing_fields", ",").alias("missing_fields"), "web_issue"
    )


_ANOMALIES = """concat_ws(',',
  case when coalesce({age}, 0) < 12 and coalesce({fare}, 0) > 100 then 'child_high_fare' end,
  case when sibsp + parch + 1 > 10 then 'large_family_size' end,
  case when pclass = 1 and coalesce({fare}, 0) < 20 then 'first_class_low_fare'
       when pclass = 3 and coalesce({fare}, 0) > 100 then 'third_class_high_fare' end)"""


@query(
    "detect_anomalies",
    PASSENGERS
    + "select passenger_id, "
    + _ANOMALIES.format(age="age", fare="fare")
    + " as anomalies from passengers",
)
def detect_anomalies_plan(t: Tables) -> DataFrame:
    df = t.passengers
    return df.select("passenger_id", F.array_join(detect_anomalies(df), ",").alias("anomalies"))


@query(
    "validate_rows",
    _RAW
    + """, checked as (
         select *, case when age is null then 'age:not_numeric' end as a,
           case when age > 120 then 'age:out_of_range' end as b,
           case when fare is null then 'fare:not_numeric' end as c,
           case when fare < 0 then 'fare:out_of_range' end as d,
           case when sex not in ('male', 'female') then 'sex:invalid_value' end as e,
           case when embarked is null then 'embarked:invalid_value' end as f
         from raw)
       select passenger_id, concat_ws(',', a, b, c, d, e, f) as issues,
         coalesce(a, b, c, d, e, f) as first_issue,
         coalesce(a, b, c, d, e, f) is null as is_valid,
         case when coalesce(a, b, c, d, e, f) is null then """
    + _ANOMALIES.format(age="age", fare="fare")
    + " end as anomalies from checked",
)
def validate_rows_plan(t: Tables) -> DataFrame:
    checked = validate_rows(_raw(t))
    shown = F.transform("issues", lambda i: F.concat_ws(":", i["field"], i["issue"]))
    return checked.select(
        "passenger_id",
        F.array_join(shown, ",").alias("issues"),
        "first_issue",
        "is_valid",
        F.array_join("anomalies", ",").alias("anomalies"),
    )


@query(
    "validate_params",
    """select event_id, event_type as endpoint,
         case when event_type = 'click' then null else 'a&lt;b ' || user_id end as note,
         case when event_type = 'click' then 'invalid_characters' end as note_issue
       from events""",
)
def validate_params_plan(t: Tables) -> DataFrame:
    note = F.when(
        F.col("event_type") == "click", F.concat(F.lit("1; drop table "), F.col("user_id"))
    ).otherwise(F.concat(F.lit("a<b "), F.col("user_id")))
    params = F.create_map(F.lit("endpoint"), F.col("event_type"), F.lit("note"), note)
    checked = t["events"].select("event_id", validate_params(params).alias("p"))
    return checked.select(
        "event_id",
        F.col("p")["endpoint"]["value"].alias("endpoint"),
        F.col("p")["note"]["value"].alias("note"),
        F.col("p")["note"]["issue"].alias("note_issue"),
    )


@query(
    "make_passenger_rows",
    """select o_orderkey, cast(1 + o_orderkey % 3 as int) as pclass, 'male' as sex,
         cast(o_custkey % 80 as double) as age, 0 as sibsp, cast(o_orderkey % 3 as int) as parch,
         o_totalprice as fare, o_orderstatus as embarked from orders""",
)
def make_passenger_rows_plan(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return make_passenger_rows(
        t["orders"],
        pclass=1 + key % 3,
        sex=F.lit("male"),
        age=F.col("o_custkey") % 80,
        sibsp=F.lit(0),
        parch=key % 3,
        fare=F.col("o_totalprice"),
        embarked=F.col("o_orderstatus"),
        keep=["o_orderkey"],
    )


# ----------------------------------------------------------------------- scores


@query("linear_score", SCORED + "select passenger_id, round(p1, 6) as p from scored")
def linear_score_plan(t: Tables) -> DataFrame:
    return linear_scores(t).select("passenger_id", F.round("p1", 6).alias("p"))


@query("ensemble_mean", SCORED + "select passenger_id, round((p1 + p2) / 2, 6) as p from scored")
def ensemble_mean_plan(t: Tables) -> DataFrame:
    joint = scores.ensemble_mean(F.col("p1"), F.col("p2"))
    return linear_scores(t).select("passenger_id", F.round(joint, 6).alias("p"))


@query(
    "threshold_class",
    SCORED
    + """select passenger_id, case when p >= 0.5 then 'survived' else 'did_not_survive' end
         as prediction, case when round(p, 1) >= 0.5 then 1 else 0 end as rounded_label
       from joint""",
)
def threshold_class_plan(t: Tables) -> DataFrame:
    return linear_scores(t).select(
        "passenger_id",
        scores.threshold_class(F.col("p")).alias("prediction"),
        scores.threshold_label(F.round("p", 1)).alias("rounded_label"),
    )


@query(
    "threshold_class_strict",
    SCORED
    + """select passenger_id, case when p > 0.5 then 'survived' else 'did_not_survive' end
         as prediction, case when round(p, 1) > 0.5 then 1 else 0 end as rounded_label
       from joint""",
)
def threshold_class_strict_plan(t: Tables) -> DataFrame:
    return linear_scores(t).select(
        "passenger_id",
        scores.threshold_class(F.col("p"), strict=True).alias("prediction"),
        scores.threshold_label(F.round("p", 1), strict=True).alias("rounded_label"),
    )


@query(
    "confidence_margin",
    SCORED
    + """select passenger_id, round(abs(p - 0.5) * 2, 6) as confidence,
         case when abs(p - 0.5) * 2 > 0.7 then 'high' when abs(p - 0.5) * 2 > 0.4 then 'medium'
           else 'low' end as confidence_level
       from joint""",
)
def confidence_margin_plan(t: Tables) -> DataFrame:
    margin = scores.confidence_margin(F.col("p"))
    return linear_scores(t).select(
        "passenger_id",
        F.round(margin, 6).alias("confidence"),
        scores.confidence_level(margin, scores.MARGIN_LEVELS).alias("confidence_level"),
    )


@query(
    "confidence_agreement",
    SCORED
    + """select passenger_id, round(1 - abs(p1 - p2), 6) as confidence,
         case when 1 - abs(p1 - p2) > 0.8 then 'high' when 1 - abs(p1 - p2) > 0.6 then 'medium'
           else 'low' end as confidence_level
       from joint""",
)
def confidence_agreement_plan(t: Tables) -> DataFrame:
    agreement = scores.confidence_agreement(F.col("p1"), F.col("p2"))
    return linear_scores(t).select(
        "passenger_id",
        F.round(agreement, 6).alias("confidence"),
        scores.confidence_level(agreement, scores.AGREEMENT_LEVELS).alias("confidence_level"),
    )


@query(
    "round3",
    SCORED
    + """select passenger_id, cast(printf('%.3f', p) as double) as p,
       cast(printf('%.3f', (passenger_id % 16) / 16) as double) as tie from joint""",
)
def round3_plan(t: Tables) -> DataFrame:
    return linear_scores(t).select(
        "passenger_id",
        scores.round3(F.col("p")).alias("p"),
        scores.round3((F.col("passenger_id") % 16) / 16).alias("tie"),
    )


@query(
    "percent_text",
    SCORED
    + """select passenger_id, cast(cast(floor(p * 100 + 0.5) as bigint) as varchar) || '%' as whole,
       printf('%.1f%%', p * 100) as tenth from joint""",
)
def percent_text_plan(t: Tables) -> DataFrame:
    return linear_scores(t).select(
        "passenger_id",
        scores.percent_whole(F.col("p")).alias("whole"),
        scores.percent_tenth(F.col("p")).alias("tenth"),
    )


# ----------------------------------------------------------- units and formats


@query(
    "bytes_units",
    """select doc_id,
         cast(printf('%.2f', n_chars * 1000 / (1024.0::double * 1024)) as double) as mb,
         cast(printf('%.2f', n_chars * 1000000 / (1024.0::double * 1024 * 1024)) as double) as gb
       from documents""",
)
def bytes_units_plan(t: Tables) -> DataFrame:
    return t["documents"].select(
        "doc_id",
        formats.bytes_in(F.col("n_chars") * 1000, "mb").alias("mb"),
        formats.bytes_in(F.col("n_chars") * 1000000, "gb").alias("gb"),
    )


@query(
    "resource_severity",
    """with m as (
         select event_id, least(value, 100) as cpu,
           cast(json_extract_string(props, '$.k') as double) as memory,
           least(value / 2, 100) as disk from events),
       l as (select event_id, case when cpu > 95 then 2 when cpu > 80 then 1 else 0 end as cpu_level,
           case when memory > 95 then 2 when memory > 85 then 1 else 0 end as memory_level,
           case when disk > 98 then 2 when disk > 90 then 1 else 0 end as disk_level from m)
       select *, case greatest(cpu_level, memory_level, disk_level) when 2 then 'unhealthy'
         when 1 then 'degraded' else 'healthy' end as status from l""",
)
def resource_severity_plan(t: Tables) -> DataFrame:
    usage = t["events"].select(
        "event_id",
        F.least(F.col("value"), F.lit(100.0)).alias("cpu"),
        F.get_json_object("props", "$.k").cast("double").alias("memory"),
        F.least(F.col("value") / 2, F.lit(100.0)).alias("disk"),
    )
    return health.resource_severity(usage, "cpu", "memory", "disk").drop("cpu", "memory", "disk")


@query(
    "iso_utc",
    "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp from events",
)
def iso_utc_plan(t: Tables) -> DataFrame:
    return t["events"].select("event_id", formats.iso_utc(F.col("ts")).alias("timestamp"))


_LEVELS = {"view": "warn", "click": "exception", "signup": "Info", "purchase": "notice"}


@query(
    "normalize_level",
    """select event_id, case event_type when 'view' then 'WARNING' when 'click' then 'ERROR'
       when 'signup' then 'INFO' when 'purchase' then 'NOTICE' else 'ERROR' end as level
       from events""",
)
def normalize_level_plan(t: Tables) -> DataFrame:
    raw = F.coalesce(formats.lookup(F.col("event_type"), _LEVELS), F.col("event_type"))
    return t["events"].select("event_id", formats.normalize_level(raw).alias("level"))


@query(
    "add_context",
    """select event_id, 'scoring-api' as service, '2.0.0' as version,
       'production' as environment from events""",
)
def add_context_plan(t: Tables) -> DataFrame:
    return formats.add_context(t["events"].select("event_id"), "scoring-api", "2.0.0", "production")


@query(
    "key_kind",
    """select event_id, case when event_type = 'error' then 'ip' else 'user' end as kind,
       case when event_type = 'error' then '10.0.0.' || (event_id % 250)
         else cast(user_id as varchar) end as value from events""",
)
def key_kind_plan(t: Tables) -> DataFrame:
    user = F.when(F.col("event_type") != "error", F.col("user_id"))
    key = formats.limit_key(user, F.concat(F.lit("10.0.0."), F.col("event_id") % 250))
    return t["events"].select(
        "event_id", formats.key_kind(key).alias("kind"), formats.key_value(key).alias("value")
    )


@query(
    "parse_rate",
    """with e as (select event_id, event_type, cast(json_extract_string(props, '$.k') as int) as k
         from events)
       select event_id, case when event_type = 'error' then null else k end as n,
         case event_type when 'view' then 'second' when 'click' then 'minute'
           when 'signup' then 'hour' when 'purchase' then 'day' end as unit,
         case event_type when 'view' then 1 when 'click' then 60
           when 'signup' then 3600 when 'purchase' then 86400 end as seconds from e""",
)
def parse_rate_plan(t: Tables) -> DataFrame:
    kind, count = F.col("event_type"), F.get_json_object("props", "$.k")
    text = (
        F.when(kind == "view", F.concat(count, F.lit("/second")))
        .when(kind == "click", F.concat(count, F.lit(" per minute")))
        .when(kind == "signup", F.concat(count, F.lit("/Hour")))
        .when(kind == "purchase", F.concat(count, F.lit("/day")))
        .otherwise(F.concat(count, F.lit(" often")))
    )
    rate = formats.parse_rate(text)
    return t["events"].select(
        "event_id",
        rate["count"].alias("n"),
        rate["unit"].alias("unit"),
        rate["seconds"].alias("seconds"),
    )


@query(
    "parse_duration",
    """with e as (select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k
         from events)
       select event_id, case event_type when 'view' then k when 'click' then k * 60
         when 'signup' then k * 3600 when 'purchase' then k * 86400 end as seconds from e""",
)
def parse_duration_plan(t: Tables) -> DataFrame:
    kind, count = F.col("event_type"), F.get_json_object("props", "$.k")
    unit = formats.lookup(kind, {"view": "s", "click": "m", "signup": "h", "purchase": "d"})
    text = F.concat(count, F.coalesce(unit, F.lit("w")))
    return t["events"].select("event_id", formats.parse_duration(text).alias("seconds"))


@query("short_request_id", "select event_id, true as well_formed from events")
def short_request_id_plan(t: Tables) -> DataFrame:
    """The ids are random, so only their form can be compared."""
    ids = t["events"].select("event_id", formats.short_request_id().alias("short_id"))
    return ids.select("event_id", F.col("short_id").rlike("^[0-9a-f]{8}$").alias("well_formed"))


@query(
    "normalize_case",
    """select c_custkey, lower(trim('  ' || c_mktsegment || ' ')) as lowered,
       upper(trim(' ' || c_name || ' ')) as uppered from customer""",
)
def normalize_case_plan(t: Tables) -> DataFrame:
    pad = F.lit("  ")
    return t["customer"].select(
        "c_custkey",
        normalize_case(F.concat(pad, "c_mktsegment", pad)).alias("lowered"),
        normalize_case(F.concat(pad, "c_name", pad), upper=True).alias("uppered"),
    )


@query(
    "label_lookup",
    PASSENGERS
    + """select passenger_id, case pclass when 1 then 'First' when 2 then 'Second' else 'Third' end
           as class_name,
         case embarked when 'C' then 'Cherbourg' when 'Q' then 'Queenstown'
           when 'S' then 'Southampton' end as port_name,
         upper(substr(sex, 1, 1)) || substr(sex, 2) as sex_title,
         '$' || printf('%.2f', fare) as fare_text from passengers""",
)
def label_lookup_plan(t: Tables) -> DataFrame:
    return t.passengers.select(
        "passenger_id",
        formats.lookup(F.col("pclass"), formats.CLASS_NAMES).alias("class_name"),
        formats.lookup(F.col("embarked"), formats.PORT_NAMES).alias("port_name"),
        F.initcap("sex").alias("sex_title"),
        F.when(F.col("fare").isNotNull(), formats.money(F.col("fare"))).alias("fare_text"),
    )


_ERRORS = {
    "view": "MODEL_UNAVAILABLE",
    "click": "VALIDATION_ERROR",
    "signup": "AUTHENTICATION_ERROR",
    "purchase": "BUSINESS_LOGIC_ERROR",
}


@query(
    "error_status",
    """select event_id, case event_type when 'view' then 503 when 'click' then 400
       when 'signup' then 401 when 'purchase' then 422 else 500 end as status_code from events""",
)
def error_status_plan(t: Tables) -> DataFrame:
    code = F.coalesce(formats.lookup(F.col("event_type"), _ERRORS), F.lit("UNKNOWN"))
    return t["events"].select("event_id", health.error_status(code).alias("status_code"))


@query(
    "flatten_error_path",
    """select event_id, 'body.' || event_type || '=bad ' || event_type || '|Invalid value;body.age=too old'
       as errors from events""",
)
def flatten_error_path_plan(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    error = lambda loc, msg: F.struct(loc.alias("loc"), msg.alias("msg"))
    errors = F.array(
        error(F.array(F.lit("body"), kind), F.concat(F.lit("bad "), kind)),
        error(F.array(F.lit("body"), F.lit("age")), F.lit("too old")),
        error(F.array(F.lit("body"), kind), F.lit(None).cast("string")),
    )
    entries = F.transform(
        F.map_entries(health.field_errors(errors)),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")),
    )
    return t["events"].select("event_id", F.array_join(entries, ";").alias("errors"))
