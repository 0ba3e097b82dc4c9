"""Typed documents: every field value wrapped in a struct that names its type.

A document is one JSON text ``{"name", "fields", "createTime", "updateTime"}``. Rows
are encoded by walking their schema, so the whole codec is made of built-in columns.
Only VARIANT values, whose shape differs from row to row, go through Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .names import doc_id_from_path

# The type names of the wrapped values.
TAGS = {
    "null": "nullValue",
    "string": "stringValue",
    "boolean": "booleanValue",
    "integer": "integerValue",
    "double": "doubleValue",
    "timestamp": "timestampValue",
    "array": "arrayValue",
    "map": "mapValue",
}
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

NULL_JSON = json.dumps({TAGS["null"]: None}, separators=(",", ":"))

#: One wrapped value as read from JSON; arrays and maps stay JSON for the next level.
TAGGED = T.StructType(
    [
        T.StructField(TAGS["string"], T.StringType()),
        T.StructField(TAGS["boolean"], T.BooleanType()),
        T.StructField(TAGS["integer"], T.StringType()),
        T.StructField(TAGS["double"], T.DoubleType()),
        T.StructField(TAGS["timestamp"], T.StringType()),
        T.StructField(TAGS["array"], T.StringType()),
        T.StructField(TAGS["map"], T.StringType()),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), TAGGED)),
        T.StructField("createTime", T.StringType()),
        T.StructField("updateTime", T.StringType()),
    ]
)
_VALUES = T.StructType([T.StructField("values", T.ArrayType(TAGGED))])
_FIELDS = T.StructType([T.StructField("fields", T.MapType(T.StringType(), TAGGED))])


# ---------------------------------------------------------------- encoding


def check_encodable(schema: T.StructType) -> None:
    """Raise ``TypeError`` for a type that typed documents do not have."""

    def check(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                check(field.dataType, f"{path}.{field.name}")
        elif isinstance(kind, T.ArrayType):
            check(kind.elementType, f"{path}[]")
        elif isinstance(kind, T.MapType):
            if not isinstance(kind.keyType, T.StringType):
                raise TypeError(f"unsupported map key type at {path}: {kind.simpleString()}")
            check(kind.valueType, f"{path}.*")
        elif not isinstance(
            kind,
            (
                T.StringType,
                T.BooleanType,
                T.IntegralType,
                T.FractionalType,
                T.TimestampType,
                T.TimestampNTZType,
                T.NullType,
                T.VariantType,
            ),
        ):
            raise TypeError(f"unsupported type at {path}: {kind.simpleString()}")

    for field in schema.fields:
        check(field.dataType, field.name)


def _wrap_text(tag: str, value: Column) -> Column:
    """Wrapped JSON string; for plain characters, which need no escapes."""
    return F.concat(F.lit(f'{{"{TAGS[tag]}":"'), value, F.lit('"}'))


def _wrap_literal(tag: str, value: Column) -> Column:
    """Wrapped JSON number or boolean."""
    return F.concat(F.lit(f'{{"{TAGS[tag]}":'), value.cast("string"), F.lit("}"))


def _shortest(value: Column) -> Column:
    """Scientific text with the fewest digits that read back to the same double."""
    tries = [F.format_string(f"%.{places}e", value) for places in (14, 15)]
    exact = F.format_string("%.16e", value)
    return F.coalesce(*[F.when(t.try_cast("double") == value, t) for t in tries], exact)


def _integral_text(value: Column) -> Column:
    """Digits of an integral double; exponent form from 1e21 on."""
    text = _shortest(value)  # like 5.902958103587057e+20
    mantissa = F.regexp_extract(text, r"^-?([\d.]+)", 1)
    exponent = F.regexp_extract(text, r"e\+(\d+)$", 1).try_cast("int")
    digits = F.rpad(F.replace(mantissa, F.lit("."), F.lit("")), exponent + 1, F.lit("0"))
    scientific = F.regexp_replace(text, r"\.?0+e", "e")
    magnitude = F.abs(value)
    return (
        F.when(magnitude < 2.0**53, value.try_cast("bigint").cast("string"))
        .when(magnitude < 1e21, F.concat(F.when(value < 0, "-").otherwise(""), digits))
        .otherwise(scientific)
    )


def _encode(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NullType):
        return F.lit(NULL_JSON)
    if isinstance(kind, T.StringType):
        body = F.to_json(F.struct(value.alias(TAGS["string"])))
    elif isinstance(kind, T.BooleanType):
        body = _wrap_literal("boolean", value)
    elif isinstance(kind, T.IntegralType):
        body = _wrap_text("integer", value.cast("string"))
    elif isinstance(kind, T.FractionalType):
        number = value.cast("double")
        finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
        body = (
            F.when(~finite, F.lit(f'{{"{TAGS["double"]}":null}}'))
            .when(number == F.rint(number), _wrap_text("integer", _integral_text(number)))
            .otherwise(_wrap_literal("double", number))
        )
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        body = _wrap_text("timestamp", F.date_format(value, ISO_MILLIS))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda item: _encode(item, kind.elementType))
        body = F.concat(
            F.lit(f'{{"{TAGS["array"]}":{{"values":['), F.array_join(items, ","), F.lit("]}}")
        )
    elif isinstance(kind, T.MapType):
        members = F.transform(
            F.map_entries(value),
            lambda entry: F.concat(
                _json_key(entry["key"]), F.lit(":"), _encode(entry["value"], kind.valueType)
            ),
        )
        body = _map_json(F.array_join(members, ","))
    elif isinstance(kind, T.StructType):
        body = _map_json(_members(kind.fields, lambda name: value[name]))
    elif isinstance(kind, T.VariantType):
        body = encode_json(F.to_json(value))
    else:
        raise TypeError(f"unsupported type: {kind.simpleString()}")
    return F.when(value.isNull(), F.lit(NULL_JSON)).otherwise(body)


def _json_key(name: Column) -> Column:
    """A text as a JSON string literal."""
    wrapped = F.to_json(F.struct(name.alias("k")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _map_json(members: Column) -> Column:
    return F.concat(F.lit(f'{{"{TAGS["map"]}":{{"fields":{{'), members, F.lit("}}}"))


def _members(fields: Iterable[T.StructField], pick) -> Column:
    return F.concat_ws(
        ",",
        *[
            F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), _encode(pick(f.name), f.dataType))
            for f in fields
        ],
    )


def encode_fields(df: DataFrame, exclude: Iterable[str] = ()) -> Column:
    """JSON text of the wrapped fields of a row."""
    skipped = set(exclude)
    fields = [f for f in df.schema.fields if f.name not in skipped]
    check_encodable(T.StructType(fields))
    return F.concat(F.lit("{"), _members(fields, lambda n: F.col(f"`{n}`")), F.lit("}"))


def encode_typed(
    df: DataFrame, id_col: str, collection: str, stamp: Column | None = None
) -> DataFrame:
    """Plain rows to one JSON document text per row, column ``value``."""
    name = F.concat(F.lit(f"{collection}/"), F.col(id_col).cast("string"))
    fields = encode_fields(df, exclude=[id_col])
    return df.select(document_json(name, fields, stamp).alias("value"))


def document_json(name: Column, fields: Column, stamp: Column | None = None) -> Column:
    head = F.to_json(F.struct(name.alias("name")))
    parts = [_open(head), F.lit(',"fields":'), fields]
    if stamp is not None:
        text = F.date_format(stamp, ISO_MILLIS)
        times = F.to_json(F.struct(text.alias("createTime"), text.alias("updateTime")))
        parts += [F.lit(","), F.substring(times, F.lit(2), F.length(times) - 1)]
        return F.concat(*parts)
    return F.concat(*parts, F.lit("}"))


def _open(json_object: Column) -> Column:
    """A JSON object without its closing brace."""
    return F.substring(json_object, F.lit(1), F.length(json_object) - 1)


def ensure_typed(df: DataFrame, fields_col: str = "fields", exclude: Iterable[str] = ()) -> Column:
    """Keep wrapped fields where present, wrap the plain columns elsewhere."""
    plain = encode_fields(df, exclude=[fields_col, *exclude])
    return F.coalesce(F.col(fields_col), plain)


# ---------------------------------------------------------------- decoding


def _decode(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return value[TAGS["string"]]
    if isinstance(kind, T.BooleanType):
        return value[TAGS["boolean"]]
    if isinstance(kind, T.IntegralType):
        leading = F.regexp_extract(value[TAGS["integer"]], r"^\s*([+-]?\d+)", 1)
        return leading.try_cast(kind)
    if isinstance(kind, T.FractionalType):
        return F.coalesce(
            value[TAGS["double"]], value[TAGS["integer"]].try_cast("double")
        ).cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(value[TAGS["timestamp"]])
    if isinstance(kind, T.ArrayType):
        items = F.from_json(value[TAGS["array"]], _VALUES)["values"]
        return F.transform(items, lambda item: _decode(item, kind.elementType))
    if isinstance(kind, T.MapType):
        members = F.from_json(value[TAGS["map"]], _FIELDS)["fields"]
        return F.transform_values(members, lambda _, item: _decode(item, kind.valueType))
    if isinstance(kind, T.StructType):
        members = F.from_json(value[TAGS["map"]], _FIELDS)["fields"]
        rebuilt = F.struct(
            *[
                _decode(F.try_element_at(members, F.lit(f.name)), f.dataType).alias(f.name)
                for f in kind.fields
            ]
        )
        return F.when(members.isNotNull(), rebuilt)
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(decode_json(F.to_json(value)))
    raise TypeError(f"unsupported type: {kind.simpleString()}")


def decode_typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Documents of any fields, read with ``DOCUMENT``, to plain rows plus ``id``.

    ``unwrap_documents`` is cheaper where the schema is known before the scan.
    The JSON of a nested map is parsed once, into a column of its own, and its fields
    are picked from there, level by level. Fields that are null stay null.
    """
    level = [(f"__{i}", f.dataType) for i, f in enumerate(schema.fields)]
    work = raw.select(
        doc_id_from_path(F.col("name")).alias("id"),
        *[
            F.try_element_at("fields", F.lit(f.name)).alias(column)
            for f, (column, _) in zip(schema.fields, level)
        ],
    )
    while opened := [(c, kind) for c, kind in level if isinstance(kind, T.StructType)]:
        members = {f"{c}m": F.from_json(F.col(c)[TAGS["map"]], _FIELDS)["fields"] for c, _ in opened}
        work = work.withColumns(members).withColumns(
            {
                f"{c}_{i}": F.try_element_at(f"{c}m", F.lit(f.name))
                for c, kind in opened
                for i, f in enumerate(kind.fields)
            }
        )
        level = [(f"{c}_{i}", f.dataType) for c, kind in opened for i, f in enumerate(kind.fields)]

    def plain(column: str, kind: T.DataType) -> Column:
        if not isinstance(kind, T.StructType):
            return _decode(F.col(column), kind)
        parts = [
            plain(f"{column}_{i}", f.dataType).alias(f.name) for i, f in enumerate(kind.fields)
        ]
        return F.when(F.col(f"{column}m").isNotNull(), F.struct(*parts))

    return work.select(
        "id", *[plain(f"__{i}", f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    )


def wrapped_type(kind: T.DataType) -> T.DataType:
    """Type of the wrapped form of a known type, with just the members it can have."""

    def one(**members: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(TAGS[k], t) for k, t in members.items()])

    if isinstance(kind, T.BooleanType):
        return one(boolean=kind)
    if isinstance(kind, T.IntegralType):
        return one(integer=T.StringType())
    if isinstance(kind, T.FractionalType):
        return one(double=T.DoubleType(), integer=T.StringType())
    if isinstance(kind, T.TimestampType):
        return one(timestamp=T.StringType())
    if isinstance(kind, T.ArrayType):
        items = T.ArrayType(wrapped_type(kind.elementType))
        return one(array=T.StructType([T.StructField("values", items)]))
    if isinstance(kind, T.MapType):
        members = T.MapType(T.StringType(), wrapped_type(kind.valueType))
        return one(map=T.StructType([T.StructField("fields", members)]))
    if isinstance(kind, T.StructType):
        fields = T.StructType([T.StructField(f.name, wrapped_type(f.dataType)) for f in kind.fields])
        return one(map=T.StructType([T.StructField("fields", fields)]))
    if isinstance(kind, T.VariantType):
        return T.StringType()  # the JSON text of the wrapped value
    return one(string=T.StringType())


def document_type(schema: T.StructType) -> T.StructType:
    """Type of the documents whose plain rows have this schema."""
    fields = [T.StructField(f.name, wrapped_type(f.dataType)) for f in schema.fields]
    return T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("fields", T.StructType(fields))]
    )


def _unwrap(value: Column, kind: T.DataType) -> Column:
    """The plain value of a wrapped one that was parsed with its own type."""
    if isinstance(kind, T.ArrayType):
        items = value[TAGS["array"]]["values"]
        return F.transform(items, lambda item: _unwrap(item, kind.elementType))
    if isinstance(kind, T.MapType):
        members = value[TAGS["map"]]["fields"]
        return F.transform_values(members, lambda _, item: _unwrap(item, kind.valueType))
    if isinstance(kind, T.StructType):
        members = value[TAGS["map"]]["fields"]
        plain = [_unwrap(members[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(members.isNotNull(), F.struct(*plain))
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(decode_json(value))
    return _decode(value, kind)


def unwrap_documents(documents: DataFrame, schema: T.StructType) -> DataFrame:
    """Documents read with ``document_type(schema)`` to plain rows, plus ``id``."""
    return documents.select(
        doc_id_from_path(F.col("name")).alias("id"),
        *[_unwrap(F.col("fields")[f.name], f.dataType).alias(f.name) for f in schema.fields],
    )


# ------------------------------------------- values whose shape varies by row


def _js_number(value: float) -> dict:
    if isinstance(value, float) and not value.is_integer():
        return {TAGS["double"]: value}
    if abs(value) < 1e21:
        exact = int(value)
        # beyond 2**53 the shortest digits that read back, padded with zeros
        text = str(exact) if abs(exact) < 2**53 or isinstance(value, int) else _padded(value)
        return {TAGS["integer"]: text}
    mantissa, exponent = repr(float(value)).split("e")
    return {TAGS["integer"]: f"{mantissa.removesuffix('.0')}e{exponent}"}


def _padded(value: float) -> str:
    """Shortest digits that read back to the same double, filled up with zeros."""
    digits = Decimal(repr(value)).as_tuple().digits
    plain = "".join(map(str, digits)).rstrip("0")
    width = Decimal(repr(value)).adjusted() + 1
    return ("-" if value < 0 else "") + plain.ljust(width, "0")


def wrap_value(value: object) -> dict:
    """One parsed JSON value to its wrapped form."""
    if value is None:
        return {TAGS["null"]: None}
    if isinstance(value, bool):
        return {TAGS["boolean"]: value}
    if isinstance(value, str):
        return {TAGS["string"]: value}
    if isinstance(value, (int, float)):
        return {TAGS["double"]: None} if not math.isfinite(value) else _js_number(value)
    if isinstance(value, list):
        return {TAGS["array"]: {"values": [wrap_value(item) for item in value]}}
    return {TAGS["map"]: {"fields": {key: wrap_value(item) for key, item in value.items()}}}


def unwrap_value(value: dict) -> object:
    """One wrapped value to the plain JSON value it stands for."""
    kind = next((name for name, tag in TAGS.items() if value.get(tag) is not None), "null")
    body = value.get(TAGS[kind])
    if kind in ("array", "map") and isinstance(body, str):
        body = json.loads(body)
    if kind == "integer":
        return float(body) if "e" in body else int(body)
    if kind == "array":
        items = body.get("values")
        return None if items is None else [unwrap_value(item) for item in items]
    if kind == "map":
        members = body.get("fields")
        return None if members is None else {k: unwrap_value(v) for k, v in members.items()}
    return body


def _dumps(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def encode_json(values: pd.Series) -> pd.Series:
    """JSON texts of any shape to wrapped JSON texts."""
    return values.map(lambda text: _dumps(wrap_value(json.loads(text))), na_action="ignore")


@F.pandas_udf(T.StringType())
def decode_json(values: pd.Series) -> pd.Series:
    """Wrapped JSON texts to plain JSON texts."""
    return values.map(lambda text: _dumps(unwrap_value(json.loads(text))), na_action="ignore")
