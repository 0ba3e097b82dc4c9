"""Masking of sensitive keys and JSON texts of whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# What marks a key as sensitive, and the mask.
SENSITIVE_KEYS = ["password", "token", "api_key", "secret", "private_key"]
MASK = "[REDACTED]"

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def is_sensitive(key: str) -> bool:
    return any(word in key.lower() for word in SENSITIVE_KEYS)


def _is_sensitive_column(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE_KEYS))


#: Levels of a VARIANT value that are walked. What lies deeper is masked whole if it names a
#: sensitive key, so nothing is let through.
VARIANT_LEVELS = 8


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _walk_variant(value: Column, levels: int) -> Column:
    """A VARIANT value rebuilt from its members and items, each of its own type."""
    if not levels:
        key = r'"(?:[^"\\]|\\.)*(?:' + "|".join(SENSITIVE_KEYS) + r')(?:[^"\\]|\\.)*":'
        return F.when(F.lower(F.to_json(value)).rlike(key), F.lit(MASK).cast("variant")).otherwise(value)

    def rebuilt(parts: Column) -> Column:
        members, items = parts["members"], parts["items"]
        named = F.transform(F.map_entries(members), lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value")))
        plain = F.transform(items, lambda item: F.struct(F.lit(None).cast("string").alias("key"), item.alias("value")))
        masked = F.transform(
            F.coalesce(named, plain),
            lambda m: F.struct(
                m["key"].alias("key"),
                F.when(_is_sensitive_column(m["key"]), F.lit(MASK).cast("variant"))
                .otherwise(_walk_variant(m["value"], levels - 1))
                .alias("value"),
            ),
        )
        return _let(
            masked,
            lambda m: F.when(members.isNotNull(), F.to_variant_object(F.map_from_entries(m)))
            .when(items.isNotNull(), F.to_variant_object(F.transform(m, lambda x: x["value"])))
            .otherwise(value),
        )

    parts = F.struct(
        F.try_variant_get(value, "$", "map<string,variant>").alias("members"),
        F.try_variant_get(value, "$", "array<variant>").alias("items"),
    )
    return _let(parts, rebuilt)


def _mask_variant(value: Column) -> Column:
    """Only values that name a sensitive word are walked."""
    named = F.lower(F.to_json(value)).rlike("|".join(SENSITIVE_KEYS))
    return F.when(named, _walk_variant(value, VARIANT_LEVELS)).otherwise(value)


def _mask_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        masked = F.struct(
            *[
                F.lit(MASK).alias(f.name)
                if is_sensitive(f.name)
                else _mask_value(value[f.name], f.dataType).alias(f.name)
                for f in kind.fields
            ]
        )
        return F.when(value.isNotNull(), masked)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _mask_value(item, kind.elementType))
    if isinstance(kind, T.MapType):
        # all values of a map share a type: texts and VARIANT can say so, others go
        says = isinstance(kind.valueType, (T.StringType, T.VariantType))
        hidden = F.lit(MASK if says else None).cast(kind.valueType)
        return F.transform_values(
            value,
            lambda key, item: F.when(_is_sensitive_column(key.cast("string")), hidden).otherwise(
                _mask_value(item, kind.valueType)
            ),
        )
    if isinstance(kind, T.VariantType):
        return _mask_variant(value)
    return value


def redact_keys(df: DataFrame) -> DataFrame:
    """Mask every sensitive key, at any depth of structs, arrays, maps and VARIANT.

    A map keeps its type: where its values are neither texts nor VARIANT, a masked one is
    null. What is not masked inside a VARIANT keeps its type.
    """
    return df.select(
        *[
            F.lit(MASK).alias(f.name)
            if is_sensitive(f.name)
            else _mask_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def _sorted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        names = sorted(kind.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in names])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _sorted(item, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(
            keys, F.transform(keys, lambda key: _sorted(value[key], kind.valueType))
        )
    return value


def to_sorted_json(df: DataFrame) -> Column:
    """One JSON text per row: keys sorted at every level, nulls kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    row = F.struct(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    return F.to_json(row, {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT})


def error_record(name: Column, message: Column, stack: Column) -> Column:
    """An error as the three values a log keeps of it."""
    return F.struct(name.alias("name"), message.alias("message"), stack.alias("stack"))


def serialize_nested(value: Column) -> Column:
    """JSON text of a nested value, timestamps as ISO with milliseconds."""
    return F.to_json(
        value, {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}
    )
