"""Statistics, evaluation, health rollups and request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import threshold_label
from ..operators import evaluate as ev
from ..operators import health
from ..operators.features import derive_features
from ..operators.preparation import REQUIRED_STATS, Preparation, fit_categories
from ..operators.profile import label_rate, null_counts, profile_columns, shape
from ..operators.requests import (
    prediction_results,
    rate_limit_decide,
    rate_limit_headers,
    request_metrics,
    sign_in_outcomes,
    user_activity,
)
from ..operators.statistics import exact_medians, modes, value_counts
from ..operators.training import split_rows
from ..operators.validate import (
    anomaly_counts,
    detect_anomalies,
    issue_counts,
    validate_rows,
)
from ..session import durable
from ..sources.tables import Tables
from .common import linear_scores
from .registry import AGE_GROUP, FITTED, OFF_TIE, PASSENGERS, REQUESTS, SCORED, query


@query(
    "survival_by_class_and_age",
    FITTED
    + f"""select pclass, {AGE_GROUP} as age_group, count(*) as n,
         round(avg(survived), 6) as survival_rate,
         round(avg(sibsp + parch + 1), 6) as avg_family_size
       from filled group by 1, 2""",
)
def survival_by_class_and_age(t: Tables) -> DataFrame:
    """After median imputation: label rate and mean family size by class and age band."""
    passengers = t.passengers.select("pclass", "age", "sibsp", "parch", "survived")
    filled = Preparation(stats=_medians(t)).impute(passengers)
    return (
        derive_features(filled)
        .groupBy("pclass", "age_group")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("survived"), 6).alias("survival_rate"),
            F.round(F.avg("family_size"), 6).alias("avg_family_size"),
        )
    )


def _medians(t: Tables) -> dict:
    found = exact_medians(t.passengers, ["age"])
    return {f"{name}_median": value for name, value in found.items()}


# ------------------------------------------------------------------- profiling


@query("shape", PASSENGERS + "select count(*) as n_rows, 9 as n_columns from passengers")
def shape_plan(t: Tables) -> DataFrame:
    return shape(t.passengers)


@query(
    "label_rate",
    PASSENGERS
    + """, parts as (
         select survived, case when row_number() over (
             partition by survived order by md5(passenger_id || ':42'))
           <= round(0.2 * count(*) over (partition by survived)) then 'test' else 'train' end as part
         from passengers)
       select 'all' as part, round(avg(survived), 6) as label_rate, count(*) as n from parts
       union all select part, round(avg(survived), 6), count(*) from parts group by part""",
)
def label_rate_plan(t: Tables) -> DataFrame:
    passengers = t.passengers.select("passenger_id", "survived")
    parts = label_rate(split_rows(passengers), "survived", "part")
    whole = label_rate(passengers, "survived").select(F.lit("all").alias("part"), "*")
    return whole.unionByName(parts).withColumn("label_rate", F.round("label_rate", 6))


@query(
    "null_counts",
    PASSENGERS
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) filter ({c} is null) as nulls from passengers"
        for c in (
            "passenger_id",
            "pclass",
            "sex",
            "age",
            "sibsp",
            "parch",
            "fare",
            "embarked",
            "survived",
        )
    ),
)
def null_counts_plan(t: Tables) -> DataFrame:
    return null_counts(t.passengers)


@query(
    "profile_columns",
    """select 'doc_id' as "column", 'bigint' as dtype, count(doc_id) as non_null from documents
       union all select 'text', 'string', count(text) from documents
       union all select 'lang', 'string', count(lang) from documents
       union all select 'source', 'string', count(source) from documents
       union all select 'n_chars', 'bigint', count(n_chars) from documents""",
)
def profile_columns_plan(t: Tables) -> DataFrame:
    return profile_columns(t["documents"])


# ------------------------------------------------------------------ statistics


@query(
    "fit_median",
    """select 'l_extendedprice' as "column", median(l_extendedprice) as median from lineitem
       union all select 'l_quantity', median(l_quantity) from lineitem""",
)
def fit_median_plan(t: Tables) -> DataFrame:
    found = exact_medians(t["lineitem"], ["l_extendedprice", "l_quantity"])
    return t.spark.createDataFrame(list(found.items()), "column string, median double")


@query(
    "fit_mode",
    """select 'l_shipdate' as "column", (select strftime(l_shipdate, '%Y-%m-%d') from lineitem
         group by 1 order by count(*) desc, 1 limit 1) as mode
       union all select 'l_suppkey', (select cast(l_suppkey as varchar) from lineitem
         group by 1 order by count(*) desc, 1 limit 1)""",
)
def fit_mode_plan(t: Tables) -> DataFrame:
    lines = t["lineitem"].select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"), "l_suppkey"
    )
    return modes(value_counts(lines, ["l_shipdate", "l_suppkey"]))


_CODES = """select '{c}' as "column", {c} as category,
  cast(row_number() over (order by {c}) - 1 as int) as code from (select distinct {c} from {t})"""


@query(
    "fit_categories",
    " union all ".join(
        "(" + _CODES.format(c=c, t="part") + ")" for c in ("p_name", "p_brand", "p_type")
    ),
)
def fit_categories_plan(t: Tables) -> DataFrame:
    return fit_categories(durable(value_counts(t["part"], ["p_name", "p_brand", "p_type"])))


@query("category_codes", _CODES.format(c="c_mktsegment", t="customer"))
def category_codes_plan(t: Tables) -> DataFrame:
    return fit_categories(durable(value_counts(t["customer"], ["c_mktsegment"])))


# ------------------------------------------------------------------ evaluation


@query(
    "eval_accuracy",
    "select round(avg(case when quality = toxic then 1 else 0 end), 6) as accuracy from labels",
)
def eval_accuracy_plan(t: Tables) -> DataFrame:
    score = ev.accuracy(F.col("quality"), F.col("toxic"))
    return t["labels"].agg(F.round(score, 6).alias("accuracy"))


@query(
    "eval_confusion",
    """select actual, count(*) filter (quality = actual and toxic = 0) as predicted_0,
         count(*) filter (quality = actual and toxic = 1) as predicted_1,
         count(*) filter (quality = actual and toxic = 2) as predicted_2
       from labels, (values (0), (1), (2)) g(actual) group by actual""",
)
def eval_confusion_plan(t: Tables) -> DataFrame:
    return ev.confusion(t["labels"], "quality", "toxic", labels=[0, 1, 2])


@query(
    "eval_report",
    """with c as (
         select label, count(*) filter (quality = label) as support,
           count(*) filter (toxic = label) as predicted,
           count(*) filter (quality = label and toxic = label) as hits
         from labels, (values (0), (1)) g(label) group by label),
       m as (select *, case when predicted > 0 then hits / predicted else 0 end as p,
           case when support > 0 then hits / support else 0 end as r from c),
       f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from m)
       select cast(label as varchar) as label, round(p, 6) as "precision", round(r, 6) as recall,
         round(f1, 6) as f1_score, support from f
       union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6),
         cast(sum(support) as bigint) from f
       union all select 'weighted avg', round(sum(p * support) / sum(support), 6),
         round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
         cast(sum(support) as bigint) from f""",
)
def eval_report_plan(t: Tables) -> DataFrame:
    report = ev.classification_report(t["labels"], "quality", "toxic")
    return report.select(
        "label",
        *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1_score")],
        "support",
    )


@query(
    "score_summary",
    SCORED
    + """select round(avg(p1), 6) as logistic_mean, round(avg(p2), 6) as tree_mean,
       round(avg(p), 6) as ensemble_mean from joint""",
)
def score_summary_plan(t: Tables) -> DataFrame:
    means = ev.score_summary(linear_scores(t), F.col("p1"), F.col("p2"), F.col("p"))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


_ACCURACIES = (
    SCORED
    + """,
accuracies as (
  select 'logistic_regression' as model,
    avg(case when (p1 >= 0.5) = (survived = 1) then 1 else 0 end) as accuracy from joint
  union all select 'decision_tree',
    avg(case when (p2 >= 0.5) = (survived = 1) then 1 else 0 end) from joint
  union all select 'ensemble',
    avg(case when (p >= 0.5) = (survived = 1) then 1 else 0 end) from joint
)"""
)


def _accuracies(t: Tables) -> DataFrame:
    return ev.evaluate_predictors(
        linear_scores(t),
        "survived",
        {
            "logistic_regression": threshold_label(F.col("p1")),
            "decision_tree": threshold_label(F.col("p2")),
            "ensemble": threshold_label(F.col("p")),
        },
    )


@query(
    "best_model",
    _ACCURACIES
    + """select model, round(accuracy, 6) as accuracy from accuracies
       order by accuracies.accuracy desc, case model when 'ensemble' then 1
         when 'logistic_regression' then 2 else 3 end limit 1""",
)
def best_model_plan(t: Tables) -> DataFrame:
    return ev.best_model(_accuracies(t)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "accuracy_gate",
    _ACCURACIES
    + """select model, accuracy < 0.7 as low, case when (select min(accuracy) from accuracies) < 0.7
         then 'degraded' else 'healthy' end as status from accuracies""",
)
def accuracy_gate_plan(t: Tables) -> DataFrame:
    return ev.accuracy_gate(_accuracies(t))


# ---------------------------------------------------------------------- health

CHECKS = """
with checks as (
  select user_id, cast(ts as varchar) as ts, ts as happened,
    case event_type when 'view' then 'ml_models' when 'click' then 'preprocessor'
      when 'signup' then 'configuration' when 'purchase' then 'model_files'
      else 'system_resources' end as name,
    case when value > 150 then 'unhealthy' when value > 80 then 'degraded'
      else 'healthy' end as status,
    props as message
  from events
)"""


def check_results(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return t["events"].select(
        "user_id",
        F.col("ts").alias("timestamp"),
        F.when(kind == "view", "ml_models")
        .when(kind == "click", "preprocessor")
        .when(kind == "signup", "configuration")
        .when(kind == "purchase", "model_files")
        .otherwise("system_resources")
        .alias("name"),
        F.when(value > 150, "unhealthy")
        .when(value > 80, "degraded")
        .otherwise("healthy")
        .alias("status"),
        F.col("props").alias("message"),
    )


@query(
    "status_rollup",
    CHECKS
    + """, c as (
         select user_id, count(*) as total_checks,
           count(*) filter (status = 'healthy') as healthy,
           count(*) filter (status = 'degraded') as degraded,
           count(*) filter (status = 'unhealthy') as unhealthy
         from checks group by user_id)
       select *, case when unhealthy > 0 then 'unhealthy' when degraded > 0 then 'degraded'
           else 'healthy' end as status,
         case when unhealthy > 0 then 'Service unhealthy: ' || unhealthy || ' critical issues'
           when degraded > 0 then 'Service degraded: ' || degraded || ' warnings'
           else 'All systems operational' end as message
       from c""",
)
def status_rollup_plan(t: Tables) -> DataFrame:
    return health.status_rollup(check_results(t), "user_id")


@query(
    "startup_gate",
    CHECKS
    + """, failed as (
         select name, arg_max(message, happened) as message from checks
         where status = 'unhealthy' and name <> 'system_resources' group by name)
       select name, message, 'Startup validation failed: Startup checks failed: ' || (
           select string_agg(name || ': ' || message, '; ' order by case name
             when 'ml_models' then 1 when 'preprocessor' then 2 when 'configuration' then 3 else 4 end)
           from failed) as refusal
       from failed""",
)
def startup_gate_plan(t: Tables) -> DataFrame:
    """The failed checks, and what the gate says when it refuses to start."""
    checks = check_results(t)
    refusal = None
    try:
        health.startup_gate(checks)
    except health.StartupError as error:
        refusal = str(error)
    return health.failed_startup_checks(checks).withColumn("refusal", F.lit(refusal))


@query(
    "check_prep_state",
    PASSENGERS
    + """, known as (
         select 'age_median' as name, median(age) as value from passengers
         union all select 'embarked_mode', count(distinct embarked) from passengers),
       missing as (
         select name from (values ('age_median'), ('embarked_mode'), ('fare_median')) r(name)
         where name not in (select name from known where value > 0))
       select case when count(*) > 0 then 'degraded' else 'healthy' end as status,
         count(*) as n_missing, string_agg(name, ', ' order by name) as missing from missing""",
)
def check_prep_state_plan(t: Tables) -> DataFrame:
    stats = Preparation().fit(t.passengers.drop("fare")).stats_table(t.spark)
    return health.check_prep_state(t.spark, stats, REQUIRED_STATS)


# ------------------------------------------------------- anomalies and requests


@query(
    "anomaly_counts",
    FITTED
    + """, a as (
         select case when age < 12 and fare > 100 then 'child_high_fare' end as anomaly from filled
         union all select case when sibsp + parch + 1 > 10 then 'large_family_size' end from filled
         union all select case when pclass = 1 and fare < 20 then 'first_class_low_fare'
           when pclass = 3 and fare > 100 then 'third_class_high_fare' end from filled)
       select anomaly, count(*) as n from a where anomaly is not null group by anomaly""",
)
def anomaly_counts_plan(t: Tables) -> DataFrame:
    filled = Preparation().fit(t.passengers).impute(t.passengers)
    return anomaly_counts(filled, detect_anomalies(filled))


@query(
    "issue_counts",
    PASSENGERS
    + """, i as (
         select 'age' as field, 'not_numeric' as issue from passengers where age is null
         union all select 'fare', 'not_numeric' from passengers where fare is null
         union all select 'embarked', 'invalid_value' from passengers where embarked is null)
       select field, issue, count(*) as n from i group by field, issue""",
)
def issue_counts_plan(t: Tables) -> DataFrame:
    return issue_counts(validate_rows(t.passengers))


@query(
    "request_metrics",
    REQUESTS
    + f"""select endpoint, count(*) as n, round(avg(duration_ms) + {OFF_TIE}, 6) as mean_ms,
       max(duration_ms) as max_ms,
       round(avg(case when status_code >= 400 then 1 else 0 end), 6) as error_rate
       from requests group by endpoint""",
)
def request_metrics_plan(t: Tables) -> DataFrame:
    return request_metrics(t.requests).select(
        "endpoint",
        "n",
        F.round(F.col("mean_ms") + OFF_TIE, 6).alias("mean_ms"),
        "max_ms",
        F.round("error_rate", 6).alias("error_rate"),
    )


@query("user_activity", "select user_id, count(*) as n_events from events group by user_id")
def user_activity_plan(t: Tables) -> DataFrame:
    return user_activity(t["events"])


@query(
    "sign_in_outcomes",
    """select event_type <> 'error' as success,
         case when event_type = 'error' then 'code_' || (user_id % 3) end as reason, count(*) as n
       from events group by 1, 2""",
)
def sign_in_outcomes_plan(t: Tables) -> DataFrame:
    failed = F.col("event_type") == "error"
    events = t["events"].select(
        (~failed).alias("success"),
        F.when(failed, F.concat(F.lit("code_"), F.col("user_id") % 3)).alias("reason"),
    )
    return sign_in_outcomes(events, "success", "reason")


@query(
    "prediction_results",
    SCORED
    + """select case when p >= 0.5 then 'survived' else 'did_not_survive' end as result,
       count(*) as n from joint group by 1""",
)
def prediction_results_plan(t: Tables) -> DataFrame:
    from ..functions.scores import threshold_class

    scored = linear_scores(t).select(threshold_class(F.col("p")).alias("result"))
    return prediction_results(scored, "result")


_DECIDED = (
    REQUESTS
    + """, decided as (
  select *, row_number() over (partition by user_id, date_trunc('day', ts)
    order by ts, request_id) as nth from requests)"""
)


@query(
    "rate_limit_decide",
    _DECIDED + "select request_id, user_id, nth, nth <= 3 as allowed from decided",
)
def rate_limit_decide_plan(t: Tables) -> DataFrame:
    requests = t.requests.select("request_id", "ts", "user_id")
    decided = rate_limit_decide(requests, "user_id", 3, "day")
    return decided.select("request_id", "user_id", "nth", "allowed")


@query(
    "rate_limit_headers",
    _DECIDED
    + """select request_id, nth <= 3 as allowed, 3 as "limit", '3;w=86400' as policy,
         cast(case when nth <= 3 then 3 - nth else 0 end as bigint) as remaining,
         case when nth > 3 then 60 end as retry_after,
         case when nth > 3 then cast(floor(epoch(ts)) as bigint) + 60
           else cast(epoch(date_trunc('day', ts)) as bigint) + 86400 end as reset
       from decided""",
)
def rate_limit_headers_plan(t: Tables) -> DataFrame:
    requests = t.requests.select("request_id", "ts", "user_id")
    decided = rate_limit_decide(requests, "user_id", 3, "day")
    return rate_limit_headers(decided, 3, "day").select(
        "request_id", "allowed", "limit", "policy", "remaining", "retry_after", "reset"
    )


@query(
    "stratified_split",
    PASSENGERS
    + """select passenger_id, survived, case when row_number() over (
           partition by survived order by md5(passenger_id || ':42'))
         <= round(0.2 * count(*) over (partition by survived)) then 'test' else 'train' end as part
       from passengers""",
)
def stratified_split_plan(t: Tables) -> DataFrame:
    return split_rows(t.passengers.select("passenger_id", "survived"))
