"""Nested records: redaction, JSON texts, typed documents and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import redaction, tokens, typed
from ..session import scratch_path
from ..sources import documents as docs
from ..sources.tables import Tables
from .registry import query


@query(
    "redact_keys",
    """select event_id, '[REDACTED]' as session_token, event_type as nested_kind,
         '[REDACTED]' as nested_secret, '[REDACTED]' as map_password,
         cast(user_id as varchar) as map_user, '[REDACTED]' as item_key,
         event_type as item_kind, value as number_kept, cast(null as double) as number_masked,
         '{"deep":[{"Api_Key":"[REDACTED]","kind":"' || event_type || '"}],"token":"[REDACTED]","user":'
           || user_id || '}' as payload from events""",
)
def redact_keys_plan(t: Tables) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    secretive = t.spread["events"].select(
        "event_id",
        F.col("props").alias("session_token"),
        F.struct(kind.alias("kind"), F.col("value").alias("Client_Secret")).alias("nested"),
        F.create_map(F.lit("Password"), F.col("props"), F.lit("user"), user).alias("attributes"),
        F.array(F.struct(user.alias("api_key"), kind.alias("kind"))).alias("items"),
        F.create_map(F.lit("amount"), F.col("value"), F.lit("secret"), F.col("value")).alias("numbers"),
        F.parse_json(
            F.to_json(
                F.struct(
                    "user_id",
                    F.struct(F.col("user_id").alias("pin")).alias("token"),
                    F.array(F.struct(F.col("value").alias("Api_Key"), kind.alias("kind"))).alias("deep"),
                ).dropFields("user_id").withField("user", F.col("user_id"))
            )
        ).alias("payload"),
    )
    return redaction.redact_keys(secretive).select(
        "event_id",
        "session_token",
        F.col("nested.kind").alias("nested_kind"),
        F.col("nested.Client_Secret").alias("nested_secret"),
        F.col("attributes")["Password"].alias("map_password"),
        F.col("attributes")["user"].alias("map_user"),
        F.col("items")[0]["api_key"].alias("item_key"),
        F.col("items")[0]["kind"].alias("item_kind"),
        F.col("numbers")["amount"].alias("number_kept"),
        F.col("numbers")["secret"].alias("number_masked"),
        F.to_json("payload").alias("payload"),
    )


@query(
    "to_sorted_json",
    """select event_id, '{"Zone":' || (user_id % 4) || ',"attributes":{"a":"x","b":"' || event_type
         || '"},"endpoint":"' || event_type || '","nested":{"k":'
         || json_extract_string(props, '$.k') || ',"user":' || user_id || '},"reason":'
         || case when event_type = 'error' then '"failed"' else 'null' end
         || ',"request_id":' || event_id || '}' as line from events""",
)
def to_sorted_json_plan(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.spread["events"].select(
        F.col("event_id").alias("request_id"),
        F.struct(F.col("user_id").alias("user"), k.alias("k")).alias("nested"),
        F.col("event_type").alias("endpoint"),
        (F.col("user_id") % 4).alias("Zone"),
        F.when(F.col("event_type") == "error", "failed").alias("reason"),
        F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.lit("x")).alias("attributes"),
    )
    return rows.select(
        F.col("request_id").alias("event_id"), redaction.to_sorted_json(rows).alias("line")
    )


@query(
    "serialize_nested",
    """select event_id, '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
         || '","error":{"name":"Error","message":"' || event_type
         || '","stack":null},"users":[' || user_id || ']}' as line from events""",
)
def serialize_nested_plan(t: Tables) -> DataFrame:
    error = redaction.error_record(
        F.lit("Error"), F.col("event_type"), F.lit(None).cast("string")
    )
    value = F.struct(
        F.col("ts").cast("timestamp").alias("at"),
        error.alias("error"),
        F.array("user_id").alias("users"),
    )
    return t.spread["events"].select("event_id", redaction.serialize_nested(value).alias("line"))


# ------------------------------------------------------------- typed documents


def _orders(t: Tables) -> DataFrame:
    """Orders as nested documents with every kind of value."""
    price = F.col("o_totalprice")
    return t.spread["orders"].select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").alias("customer"),
        price.alias("total"),
        F.floor(price).cast("double").alias("whole"),
        (F.col("o_orderstatus") == "F").alias("closed"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("ordered"),
        F.array(F.col("o_orderstatus"), F.lit(None).cast("string")).alias("tags"),
        F.struct(
            F.col("o_custkey").alias("key"),
            F.array(price, F.lit(1.0)).alias("prices"),
        ).alias("buyer"),
        F.create_map(F.col("o_orderstatus"), F.col("o_custkey")).alias("by_status"),
    )


_NUMBER = """case when {0} = floor({0}) then '{{"integerValue":"' || cast({0} as bigint) || '"}}'
  else '{{"doubleValue":' || {0} || '}}' end"""

_ENCODED = f"""
with fields as (
  select o_orderkey, '{{"customer":{{"integerValue":"' || o_custkey || '"}},"total":'
    || {_NUMBER.format("o_totalprice")}
    || ',"whole":{{"integerValue":"' || cast(floor(o_totalprice) as bigint) || '"}}'
    || ',"closed":{{"booleanValue":' || (o_orderstatus = 'F') || '}},"priority":'
    || case when o_orderstatus <> 'P' then '{{"stringValue":"' || o_orderpriority || '"}}'
       else '{{"nullValue":null}}' end
    || ',"ordered":{{"timestampValue":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ')
    || '"}},"tags":{{"arrayValue":{{"values":[{{"stringValue":"' || o_orderstatus
    || '"}},{{"nullValue":null}}]}}}},"buyer":{{"mapValue":{{"fields":{{"key":{{"integerValue":"'
    || o_custkey || '"}},"prices":{{"arrayValue":{{"values":[' || {_NUMBER.format("o_totalprice")}
    || ',{{"integerValue":"1"}}]}}}}}}}}}},"by_status":{{"mapValue":{{"fields":{{"' || o_orderstatus
    || '":{{"integerValue":"' || o_custkey || '"}}}}}}}}}}' as fields
  from orders)
"""


@query(
    "encode_typed",
    _ENCODED
    + """select '{"name":"orders/' || o_orderkey || '","fields":' || fields || '}' as value
       from fields""",
)
def encode_typed_plan(t: Tables) -> DataFrame:
    return typed.encode_typed(_orders(t), "id", "orders")


@query(
    "ensure_typed",
    _ENCODED
    + """select fields.o_orderkey as id, case when o_orderstatus = 'O'
         then '{"kept":{"stringValue":"as is"}}' else fields end as fields
       from fields join orders on fields.o_orderkey = orders.o_orderkey""",
)
def ensure_typed_plan(t: Tables) -> DataFrame:
    given = F.when(F.get("tags", F.lit(0)) == "O", '{"kept":{"stringValue":"as is"}}')
    rows = _orders(t).withColumn("fields", given)
    return rows.select(
        F.col("id").cast("long").alias("id"),
        typed.ensure_typed(rows, exclude=["id"]).alias("fields"),
    )


_DECODED = """select cast(o_orderkey as varchar) as id, o_custkey as customer, o_totalprice as total,
         floor(o_totalprice) as whole, o_orderstatus = 'F' as closed,
         case when o_orderstatus <> 'P' then o_orderpriority end as priority,
         strftime(o_orderdate, '%Y-%m-%d') as ordered, o_orderstatus as first_tag,
         2 as n_tags, o_custkey as buyer_key, o_totalprice + 1 as price_sum,
         o_custkey as status_value from orders"""


def _plain_orders(t: Tables, name: str, read) -> DataFrame:
    """Write the orders as typed documents, read them back, and show their parts."""
    orders = _orders(t)
    path = scratch_path(t.spark, name)
    docs.write_typed(typed.encode_typed(orders, "id", "orders"), path)
    target = T.StructType([f for f in orders.schema.fields if f.name != "id"])
    return read(path, target).select(
        "id",
        "customer",
        "total",
        "whole",
        "closed",
        "priority",
        F.date_format("ordered", "yyyy-MM-dd").alias("ordered"),
        F.col("tags")[0].alias("first_tag"),
        F.size("tags").alias("n_tags"),
        F.col("buyer.key").alias("buyer_key"),
        F.aggregate("buyer.prices", F.lit(0.0), lambda a, x: a + x).alias("price_sum"),
        F.element_at("by_status", F.col("tags")[0]).alias("status_value"),
    )


@query("decode_typed", _DECODED)
def decode_typed_plan(t: Tables) -> DataFrame:
    return _plain_orders(
        t, "orders-typed", lambda path, schema: docs.scan_collection_typed(t.spark, path, schema)
    )


@query("decode_raw", _DECODED)
def decode_raw_plan(t: Tables) -> DataFrame:
    """The same from documents that were scanned without a schema of their fields."""
    return _plain_orders(
        t,
        "orders-raw",
        lambda path, schema: typed.decode_typed(docs.scan_collection_raw(t.spark, path), schema),
    )


@query(
    "decode_variant",
    """select cast(event_id as varchar) as id, cast(json_extract_string(props, '$.k') as int) as k,
       event_type as mixed_first, user_id as mixed_second from events""",
)
def decode_variant_plan(t: Tables) -> DataFrame:
    """Values without a declared shape, encoded and decoded as VARIANT."""
    mixed = F.concat(
        F.lit('["'), F.col("event_type"), F.lit('",'), F.col("user_id"), F.lit("]")
    )
    events = t.spread["events"].select(
        F.col("event_id").cast("string").alias("id"),
        F.parse_json("props").alias("props"),
        F.parse_json(mixed).alias("mixed"),
    )
    path = scratch_path(t.spark, "events-typed")
    docs.write_typed(typed.encode_typed(events, "id", "events"), path)
    target = T.StructType(
        [T.StructField("props", T.VariantType()), T.StructField("mixed", T.VariantType())]
    )
    plain = typed.decode_typed(docs.scan_collection_raw(t.spark, path), target)
    return plain.select(
        "id",
        F.variant_get("props", "$.k", "int").alias("k"),
        F.variant_get("mixed", "$[0]", "string").alias("mixed_first"),
        F.variant_get("mixed", "$[1]", "bigint").alias("mixed_second"),
    )


# ---------------------------------------------------------------------- tokens

NOW = 1705000000  # a second inside the range of the event times


def _base64url(text: Column) -> Column:
    plain = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")  # lines of 76
    return F.regexp_replace(F.translate(plain, "+/", "-_"), "=+$", "")


def _tokens(t: Tables) -> DataFrame:
    """Tokens whose claims come from the events; those of errors lack their last part."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    issued = F.unix_timestamp(F.col("ts").cast("timestamp"))
    claims = F.to_json(
        F.struct(
            F.when(kind != "view", user).alias("user_id"),
            F.concat(F.lit("name-"), user).alias("username"),
            (issued + 3600).alias("exp"),
            issued.alias("iat"),
            F.when(kind == "click", "elsewhere").otherwise("ml-service").alias("aud"),
            F.lit("gateway").alias("iss"),
        )
    )
    head = F.lit('{"alg":"RS256","typ":"JWT"}')
    token = F.concat_ws(
        ".", _base64url(head), _base64url(claims), F.when(kind != "error", F.lit("sig"))
    )
    return t.spread["events"].select("event_id", token.alias("token"))


_CLAIMS = """
with claims as (
  select event_id, event_type, event_type <> 'error' as ok,
    case when event_type <> 'view' then cast(user_id as varchar) end as user_id,
    'name-' || user_id as username, cast(floor(epoch(ts)) as bigint) as iat
  from events)
"""


@query(
    "decode_token",
    _CLAIMS
    + """select event_id, case when ok then user_id end as user_id,
       case when ok then username end as username, case when ok then iat + 3600 end as exp,
       case when ok then iat end as iat from claims""",
)
def decode_token_plan(t: Tables) -> DataFrame:
    decoded = tokens.decode_tokens(_tokens(t), "token", "c")
    return decoded.select("event_id", "c.user_id", "c.username", "c.exp", "c.iat")


@query(
    "token_expired",
    _CLAIMS + f"select event_id, not ok or iat + 3600 < {NOW} as expired from claims",
)
def token_expired_plan(t: Tables) -> DataFrame:
    decoded = tokens.decode_tokens(_tokens(t), "token")
    expired = tokens.token_expired(F.col("claims.exp"), F.lit(NOW))
    return decoded.select("event_id", expired.alias("expired"))


@query(
    "token_claims_check",
    _CLAIMS
    + f"""select event_id, case when not ok then 'malformed'
         when iat + 3600 < {NOW} then 'expired' when event_type = 'click' then 'wrong_audience'
         when user_id is null then 'missing_user_id' end as issue from claims""",
)
def token_claims_check_plan(t: Tables) -> DataFrame:
    decoded = tokens.decode_tokens(_tokens(t), "token", "c")
    issue = tokens.claims_issue(F.col("c"), "ml-service", "gateway", F.lit(NOW))
    return decoded.select("event_id", issue.alias("issue"))
