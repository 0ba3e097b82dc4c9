"""Fitted preparation, training and scoring."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import agreement_record, margin_record
from ..operators.models import INVERSE_PENALTY, TREE_DEPTH, TREE_MIN_SPLIT, assemble, load_accuracies
from ..operators.preparation import Preparation
from ..operators.training import split_rows
from ..operators.tree import grow_tree
from ..session import scratch_path
from ..sources.tables import PASSENGER_FIELDS, Tables
from .common import CODED, held_out, linear_scores, prepared, trained
from .registry import PASSENGERS, PREPARED, SCORED, query


@query("prep_fit_transform", PREPARED + "select * from prepared")
def prep_fit_transform_plan(t: Tables) -> DataFrame:
    return prepared(t)


@query(
    "prep_transform",
    PREPARED
    + """select p.passenger_id, p.survived, pclass, sex, age, sibsp, parch, fare, embarked,
         family_size, is_alone, age_group from prepared p""",
)
def prep_transform_plan(t: Tables) -> DataFrame:
    """State fitted on one frame, applied to every row of another of other column order."""
    preparation = Preparation().fit(t.passengers)
    rows = t.passengers.select(*reversed(t.passengers.columns))
    return preparation.transform(rows).select(*CODED)


@query(
    "prep_single",
    PREPARED
    + """select pclass, sex, age, sibsp, parch, fare, embarked, family_size, is_alone, age_group
       from prepared where passenger_id = (
         select passenger_id from passengers where fare is not null
         order by fare desc, passenger_id limit 1)""",
)
def prep_single_plan(t: Tables) -> DataFrame:
    """The dearest ticket as a single request."""
    passengers = t.passengers
    dearest = passengers.where(F.col("fare").isNotNull()).orderBy(
        F.col("fare").desc(), "passenger_id"
    )
    request = dearest.select(*PASSENGER_FIELDS).first().asDict()
    schema = passengers.select(*PASSENGER_FIELDS).schema
    return Preparation().fit(passengers).single(t.spark, request, schema)


#: Passengers with the part that the split gives them.
PARTS = PASSENGERS + """, parts as (
  select *, case when row_number() over (
      partition by survived order by md5(passenger_id || ':42'))
    <= round(0.2 * count(*) over (partition by survived)) then 'test' else 'train' end as part
  from passengers)"""

FEATURES_SQL = "(values ('intercept'), " + ", ".join(f"('{c}')" for c in CODED[2:]) + ") f(feature)"


def _training_rows(t: Tables) -> DataFrame:
    parts = split_rows(t.passengers)
    rows = parts.where(F.col("part") == "train").drop("part")
    return trained(t).preparation.transform(rows)


@query(
    "train_logistic",
    PARTS
    + f"""select feature, (select count(*) from parts where part = 'train') as n_rows,
         true as stationary from {FEATURES_SQL}""",
)
def train_logistic_plan(t: Tables) -> DataFrame:
    """The weights minimise the penalised loss: its slope in every weight is next to none,
    measured over all training rows against the mean size of the feature."""
    models = trained(t).models
    scored = models.predict_proba(_training_rows(t))
    error = F.col("lr_prob") - F.col("survived")
    names = models.feature_columns
    sums = scored.agg(
        F.count("*").alias("n"),
        F.avg(error).alias("g_intercept"),
        *[F.avg(error * F.col(c)).alias(f"g_{c}") for c in names],
        *[F.avg(F.abs(F.col(c))).alias(f"s_{c}") for c in names],
    )
    slopes = [(F.lit("intercept"), F.col("g_intercept"), F.lit(1.0))]
    for name, weight in zip(names, models.logistic.coefficients):
        penalty = float(weight) / (F.lit(INVERSE_PENALTY) * F.col("n"))
        slopes.append((F.lit(name), F.col(f"g_{name}") + penalty, F.col(f"s_{name}")))
    rows = F.array(
        *[F.struct(f.alias("feature"), (F.abs(g) < 1e-3 * (1 + s)).alias("stationary")) for f, g, s in slopes]
    )
    return sums.select(F.col("n").alias("n_rows"), F.inline(rows))


@query(
    "train_tree",
    PARTS
    + """select count(*) as n_rows, true as leaves_add_up, true as leaves_large_enough,
         true as depth_in_bounds from parts where part = 'train'""",
)
def train_tree_plan(t: Tables) -> DataFrame:
    """Every training row falls into one leaf, and no leaf is smaller than allowed."""
    tree = trained(t).models.tree.copy().setLeafCol("leaf")
    rows = assemble(_training_rows(t), trained(t).models.feature_columns)
    leaves = tree.transform(rows).groupBy("leaf").count()
    return leaves.agg(
        F.sum("count").alias("n_rows"),
        (F.count("*") == (tree.numNodes + 1) // 2).alias("leaves_add_up"),
        (F.min("count") >= TREE_MIN_SPLIT // 2).alias("leaves_large_enough"),
        F.lit(tree.depth <= TREE_DEPTH).alias("depth_in_bounds"),
    )


def _test_scores(t: Tables) -> DataFrame:
    run = trained(t)
    return run.models.ensemble(held_out(t, run.preparation))


def _tested(*checks: str) -> str:
    columns = ", ".join(f"true as {c}" for c in checks)
    return PARTS + f"select passenger_id, {columns} from parts where part = 'test'"


@query("predict_proba", _tested("lr_is_probability", "dt_is_probability", "lr_is_sigmoid"))
def predict_proba_plan(t: Tables) -> DataFrame:
    """Probabilities of the held-out rows; the logistic one follows from the weights."""
    models = trained(t).models
    score = F.lit(float(models.logistic.intercept))
    for name, weight in zip(models.feature_columns, models.logistic.coefficients):
        score = score + float(weight) * F.col(name)
    sigmoid = 1 / (1 + F.exp(-score))
    return _test_scores(t).select(
        "passenger_id",
        F.col("lr_prob").between(0, 1).alias("lr_is_probability"),
        F.col("dt_prob").between(0, 1).alias("dt_is_probability"),
        (F.abs(F.col("lr_prob") - sigmoid) < 1e-9).alias("lr_is_sigmoid"),
    )


@query("predict_label", _tested("lr_follows", "dt_follows"))
def predict_label_plan(t: Tables) -> DataFrame:
    """The label of each model is the more probable class."""
    return _test_scores(t).select(
        "passenger_id",
        (F.col("lr_label") == (F.col("lr_prob") > 0.5).cast("int")).alias("lr_follows"),
        (F.col("dt_label") == (F.col("dt_prob") > 0.5).cast("int")).alias("dt_follows"),
    )


@query("ensemble_predict", _tested("is_mean", "label_follows"))
def ensemble_predict_plan(t: Tables) -> DataFrame:
    mean = (F.col("lr_prob") + F.col("dt_prob")) / 2
    return _test_scores(t).select(
        "passenger_id",
        (F.abs(F.col("ensemble_prob") - mean) < 1e-12).alias("is_mean"),
        (F.col("ensemble_label") == (mean >= 0.5).cast("int")).alias("label_follows"),
    )


def _flat(scored: DataFrame, *kept: str) -> DataFrame:
    """The score record in columns, behind the id and other columns to keep."""
    models, joint = F.col("score.individual_models"), F.col("score.ensemble_result")
    return scored.select(
        "passenger_id",
        *kept,
        models["logistic_regression"]["probability"].alias("lr_probability"),
        models["logistic_regression"]["prediction"].alias("lr_prediction"),
        models["decision_tree"]["probability"].alias("dt_probability"),
        models["decision_tree"]["prediction"].alias("dt_prediction"),
        joint["probability"].alias("probability"),
        joint["prediction"].alias("prediction"),
        joint["confidence"].alias("confidence"),
        joint["confidence_level"].alias("confidence_level"),
    )


_RECORD_CHECKS = ["same_probabilities", "same_predictions", "same_confidence", "same_level"]

_ALL_SCORED = PASSENGERS + "select passenger_id, {} from passengers".format(
    ", ".join(f"true as {c}" for c in _RECORD_CHECKS)
)


def _record_checks(t: Tables, served: bool) -> DataFrame:
    """Score records against what both probabilities say, rule by rule."""
    scored = trained(t).score(t.spread.passengers, served=served)
    flat = _flat(scored, "lr_prob", "dt_prob")
    p1, p2 = F.col("lr_prob"), F.col("dt_prob")
    mean = (p1 + p2) / 2
    exact = {"lr": p1, "dt": p2, "": mean}
    confidence = 1 - F.abs(p1 - p2) if served else F.abs(mean - 0.5) * 2
    high, medium = (0.8, 0.6) if served else (0.7, 0.4)
    level = F.when(confidence > high, "high").when(confidence > medium, "medium").otherwise("low")

    def near(a, b):
        return F.abs(a - b) <= (1e-9 if served else 0.00051)

    def name(model: str, what: str) -> str:
        return f"{model}_{what}" if model else what

    def survives(p):
        return F.when(p > 0.5 if served else p >= 0.5, "survived").otherwise("did_not_survive")

    numbers = reduce(and_, [near(F.col(name(m, "probability")), p) for m, p in exact.items()])
    labels = reduce(and_, [F.col(name(m, "prediction")) == survives(p) for m, p in exact.items()])
    return flat.select(
        "passenger_id",
        numbers.alias("same_probabilities"),
        labels.alias("same_predictions"),
        near(F.col("confidence"), confidence).alias("same_confidence"),
        (F.col("confidence_level") == level).alias("same_level"),
    )


@query("score_batch", _ALL_SCORED)
def score_batch_plan(t: Tables) -> DataFrame:
    return _record_checks(t, served=False)


@query("score_batch_served", _ALL_SCORED)
def score_batch_served_plan(t: Tables) -> DataFrame:
    return _record_checks(t, served=True)


@query(
    "margin_record",
    SCORED
    + """select passenger_id, cast(printf('%.3f', p1) as double) as lr_probability,
         case when p1 >= 0.5 then 'survived' else 'did_not_survive' end as lr_prediction,
         cast(printf('%.3f', p2) as double) as dt_probability,
         case when p2 >= 0.5 then 'survived' else 'did_not_survive' end as dt_prediction,
         cast(printf('%.3f', p) as double) as probability,
         case when p >= 0.5 then 'survived' else 'did_not_survive' end as prediction,
         cast(printf('%.3f', abs(p - 0.5) * 2) as double) as confidence,
         case when abs(p - 0.5) * 2 > 0.7 then 'high' when abs(p - 0.5) * 2 > 0.4 then 'medium'
           else 'low' end as confidence_level
       from joint""",
)
def margin_record_plan(t: Tables) -> DataFrame:
    record = margin_record(F.col("p1"), F.col("p2"))
    return _flat(linear_scores(t).withColumn("score", record))


@query(
    "agreement_record",
    SCORED
    + """select passenger_id, round(p1, 6) as lr_probability,
         case when p1 > 0.5 then 'survived' else 'did_not_survive' end as lr_prediction,
         round(p2, 6) as dt_probability,
         case when p2 > 0.5 then 'survived' else 'did_not_survive' end as dt_prediction,
         round(p, 6) as probability,
         case when p > 0.5 then 'survived' else 'did_not_survive' end as prediction,
         round(1 - abs(p1 - p2), 6) as confidence,
         case when 1 - abs(p1 - p2) > 0.8 then 'high' when 1 - abs(p1 - p2) > 0.6 then 'medium'
           else 'low' end as confidence_level
       from joint""",
)
def agreement_record_plan(t: Tables) -> DataFrame:
    record = agreement_record(F.col("p1"), F.col("p2"))
    flat = _flat(linear_scores(t).withColumn("score", record))
    numbers = ["lr_probability", "dt_probability", "probability", "confidence"]
    return flat.withColumns({name: F.round(name, 6) for name in numbers})


_MODELS_SQL = "(values ('logistic_regression'), ('decision_tree'), ('ensemble')) m(model)"


@query(
    "evaluate_models",
    PARTS
    + f"""select model, (select count(*) from parts where part = 'test') as n_rows,
         true as same_accuracy from {_MODELS_SQL}""",
)
def evaluate_models_plan(t: Tables) -> DataFrame:
    """Accuracies against hits counted from the predicted labels, row by row."""
    run = trained(t)
    labels = {"logistic_regression": "lr_label", "decision_tree": "dt_label", "ensemble": "ensemble_label"}
    hits = _test_scores(t).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c) == F.col("survived")).alias(m) for m, c in labels.items()],
    )
    counted = hits.select(
        "n_rows", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("hits")) for m in labels]))
    )
    measured = run.models.evaluate(held_out(t, run.preparation), "survived")
    same = F.abs(F.col("accuracy") * F.col("n_rows") - F.col("hits")) < 1e-6
    return measured.join(counted, "model").select("model", "n_rows", same.alias("same_accuracy"))


@query(
    "model_info",
    """select name, true as plausible from (values ('tree_depth'), ('tree_nodes'), ('n_features'),
         ('coefficient_rows'), ('coefficient_columns'), ('accuracy_logistic_regression'),
         ('accuracy_decision_tree'), ('accuracy_ensemble')) i(name)""",
)
def model_info_plan(t: Tables) -> DataFrame:
    """Figures of the models against what is stored of them: nodes, features, weights, and
    the accuracies."""
    run = trained(t)
    path = scratch_path(t.spark, "described")
    run.save(t.spark, path)
    stored = t.spark.read.parquet(f"{path}/decision_tree_model/data").select("id", "leftChild", "rightChild")
    children = {r["id"]: [c for c in (r["leftChild"], r["rightChild"]) if c >= 0] for r in stored.collect()}
    depth, level = 0, children[0]
    while level:
        depth, level = depth + 1, [c for k in level for c in children[k]]
    matrix = t.spark.read.parquet(f"{path}/logistic_model/data").first()["coefficientMatrix"]
    expected = {
        "tree_depth": float(depth),
        "tree_nodes": float(len(children)),
        "n_features": float(t.spark.read.parquet(f"{path}/model_features").count()),
        "coefficient_rows": float(matrix.numRows),
        "coefficient_columns": float(matrix.numCols),
        **{f"accuracy_{name}": value for name, value in load_accuracies(t.spark, path).items()},
    }
    wanted = t.spark.createDataFrame(list(expected.items()), "name string, wanted double")
    info = run.models.info(t.spark, run.accuracies)
    same = (F.col("value") == F.col("wanted")).alias("plausible")
    return info.join(wanted, "name", "left").select("name", same)


@query(
    "train_tree_exact",
    PREPARED
    + """, stacked as (
         select survived, unnest([cast(pclass as double), cast(sex as double), age, cast(sibsp as double),
             cast(parch as double), fare, cast(embarked as double), cast(family_size as double),
             cast(is_alone as double), cast(age_group as double)]) as value, generate_subscripts(
             [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 1) - 1 as feature
         from prepared where age_group is not null),
       counts as (select feature, value, count(*) as n, sum(survived) as p from stacked group by 1, 2),
       sums as (
         select feature, value, sum(n) over w as n, sum(p) over w as p,
           sum(n) over (partition by feature) as n_all, sum(p) over (partition by feature) as p_all,
           lead(value) over (partition by feature order by value) as above
         from counts window w as (partition by feature order by value rows unbounded preceding)),
       gains as (
         select *, (cast(p as double) * p + cast(n - p as double) * (n - p)) / n
             + (cast(p_all - p as double) * (p_all - p)
                + cast(n_all - n - p_all + p as double) * (n_all - n - p_all + p)) / (n_all - n) as gain
         from sums where n < n_all)
       select cast(n_all as bigint) as n, cast(p_all as bigint) as positives, cast(feature as int) as feature,
         round(value / 2 + above / 2, 6) as threshold, cast(n as bigint) as n_left,
         cast(p as bigint) as positives_left
       from gains order by gain desc, feature, value limit 1""",
)
def train_tree_exact_plan(t: Tables) -> DataFrame:
    """The first split of the exact tree over all rows with an age band."""
    rows = prepared(t).where("age_group is not null")
    tree = grow_tree(rows, CODED[2:], "survived", max_depth=1)

    def of(node: int, name: str) -> Column:
        return F.max(F.when(F.col("node") == node, F.col(name)))

    return tree.table(t.spark).agg(
        of(1, "n").alias("n"),
        of(1, "positives").alias("positives"),
        of(1, "feature").alias("feature"),
        F.round(of(1, "threshold"), 6).alias("threshold"),
        of(2, "n").alias("n_left"),
        of(2, "positives").alias("positives_left"),
    )
