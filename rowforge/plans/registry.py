"""Names of the registered queries, their plans and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources.tables import Tables

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan over the tables of a folder, with its SQL if SQL can say it."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Tables(configure(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = dedent(sql).strip()
        return plan

    return register


# ------------------------------------------------------ SQL shared by the oracles

PASSENGERS = """
with passengers as (
  select o_orderkey as passenger_id,
    cast(1 + o_orderkey % 3 as int) as pclass,
    case when o_custkey % 2 = 0 then 'female' else 'male' end as sex,
    case when o_orderkey % 5 = 0 then null
         else cast(1 + (o_orderkey * 7) % 79 as double) end as age,
    cast(o_custkey % 4 as int) as sibsp,
    cast((o_orderkey % 9 - o_orderkey % 3) / 3 as int) as parch,
    case when o_orderkey % 97 = 0 then null else o_totalprice / 1000 end as fare,
    case when o_orderkey % 50 = 1 then null
         when o_orderstatus = 'F' then 'C'
         when o_orderstatus = 'O' then 'S' else 'Q' end as embarked,
    case when (case when o_custkey % 2 = 0 then 3 else 0 end)
              + (2 - o_orderkey % 3) + o_orderkey % 4 >= 4 then 1 else 0 end as survived
  from orders
)"""

AGE_GROUP = """case when age > 0 and age <= 18 then 0 when age > 18 and age <= 35 then 1
       when age > 35 and age <= 60 then 2 when age > 60 and age <= 100 then 3 end"""

FITTED = (
    PASSENGERS
    + """,
fitted as (
  select median(age) as age_median, median(fare) as fare_median,
    (select embarked from passengers where embarked is not null
     group by embarked order by count(*) desc, embarked limit 1) as embarked_mode
  from passengers
),
filled as (
  select passenger_id, pclass, sex, coalesce(age, age_median) as age, sibsp, parch,
    coalesce(fare, fare_median) as fare, coalesce(embarked, embarked_mode) as embarked, survived
  from passengers cross join fitted
)"""
)

PREPARED = (
    FITTED
    + f""",
sex_codes as (
  select sex as category, cast(row_number() over (order by sex) - 1 as int) as code
  from (select distinct sex from passengers)
),
port_codes as (
  select embarked as category, cast(row_number() over (order by embarked) - 1 as int) as code
  from (select distinct embarked from filled)
),
prepared as (
  select passenger_id, survived, pclass, s.code as sex, age, sibsp, parch, fare,
    p.code as embarked, sibsp + parch + 1 as family_size,
    case when sibsp + parch + 1 = 1 then 1 else 0 end as is_alone,
    {AGE_GROUP} as age_group
  from filled f
  left join sex_codes s on f.sex = s.category
  left join port_codes p on f.embarked = p.category
)"""
)

# Fixed coefficients that stand in for two trained models.
FIRST_MODEL = {
    "pclass": -0.6,
    "sex": -1.1,
    "age": -0.01,
    "sibsp": -0.2,
    "parch": -0.1,
    "fare": 0.004,
    "embarked": -0.05,
    "family_size": 0.03,
    "is_alone": 0.1,
    "age_group": 0.05,
}
FIRST_INTERCEPT = 2.0
SECOND_MODEL = {
    "pclass": -1.0,
    "sex": -2.5,
    "age": -0.02,
    "fare": 0.006,
    "is_alone": -0.4,
}
SECOND_INTERCEPT = 3.0


def _score_sql(intercept: float, weights: dict[str, float]) -> str:
    terms = "".join(f" + cast({w!r} as double) * {c}" for c, w in weights.items())
    return f"1 / (1 + exp(-(cast({intercept!r} as double){terms})))"


SCORED = (
    PREPARED
    + f""",
scored as (
  select passenger_id, survived,
    {_score_sql(FIRST_INTERCEPT, FIRST_MODEL)} as p1,
    {_score_sql(SECOND_INTERCEPT, SECOND_MODEL)} as p2
  from prepared
),
joint as (select *, (p1 + p2) / 2 as p from scored)"""
)

REQUESTS = """
with requests as (
  select event_id as request_id, ts, user_id, event_type as endpoint, value as duration_ms,
    case when event_type = 'error' then 500 else 200 end as status_code
  from events
)"""

# Means of values with two places can lie exactly between two rounded results. Both
# sides add this, so that the last bit of a sum does not decide.
OFF_TIE = 1e-9

WORDS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')"
