"""Document queries: filters, ordering, cursors, paging and field selection.

``doc_query`` takes the options of a document client and returns one DataFrame,
applied in the order filter, order, cursor, offset, limit, select. A comparison is
true only for a present, non-null field; ordering by a field drops rows without it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .ranking import global_index
from .selection import KeyOrder, Place, select_ranks

#: Rows that a plain top-k or limit may bring to one task.
MAX_TOP_ROWS = 10_000

_TIE = "__tie"
_POSITION = "__position"

Clause = tuple[str, str, object]


# ------------------------------------------------------------------ predicates


def _resolve(df: DataFrame, field: str) -> tuple[Column, T.DataType]:
    """Column and type of a field; a dotted path reaches into structs."""
    if field in df.columns:
        column = F.col(f"`{field}`")
    else:
        column = F.col(".".join(f"`{part}`" for part in field.split(".")))
    return column, df.select(column.alias("f")).schema["f"].dataType


def _same_family(kind: T.DataType, value: object) -> bool:
    """Values compare only within their type, as documents do."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return True


def where_compare(df: DataFrame, field: str, operator: str, value: object) -> Column:
    column, kind = _resolve(df, field)
    if value is None:
        if operator == "==":
            return column.isNull()
        if operator == "!=":
            return column.isNotNull()
        return F.lit(False)
    if not _same_family(kind, value):
        return column.isNotNull() if operator == "!=" else F.lit(False)
    compared = {
        "==": column == value,
        "!=": column != value,
        "<": column < value,
        "<=": column <= value,
        ">": column > value,
        ">=": column >= value,
    }[operator]
    return column.isNotNull() & compared


def _listed(operator: str, values: object) -> Sequence[object]:
    """The values of a list operator; a text is one value and no list of letters."""
    if isinstance(values, (str, bytes)) or not isinstance(values, Sequence):
        raise ValueError(f"{operator} needs a list of values, not {values!r}")
    return values


def where_in(df: DataFrame, field: str, values: Sequence[object]) -> Column:
    values = _listed("in", values)
    column, kind = _resolve(df, field)
    usable = [v for v in values if v is not None and _same_family(kind, v)]
    return column.isNotNull() & column.isin(usable) if usable else F.lit(False)


def where_not_in(df: DataFrame, field: str, values: Sequence[object]) -> Column:
    values = _listed("not-in", values)
    column, kind = _resolve(df, field)
    usable = [v for v in values if v is not None and _same_family(kind, v)]
    present = column.isNotNull()
    return present & ~column.isin(usable) if usable else present


def where_array_contains(df: DataFrame, field: str, value: object) -> Column:
    column, kind = _resolve(df, field)
    if not isinstance(kind, T.ArrayType) or not _same_family(kind.elementType, value):
        return F.lit(False)
    return F.coalesce(F.array_contains(column, value), F.lit(False))


def where_array_contains_any(df: DataFrame, field: str, values: Sequence[object]) -> Column:
    values = _listed("array-contains-any", values)
    column, kind = _resolve(df, field)
    if not isinstance(kind, T.ArrayType):
        return F.lit(False)
    usable = [v for v in values if v is not None and _same_family(kind.elementType, v)]
    if not usable:
        return F.lit(False)
    literals = F.array(*[F.lit(v) for v in usable])
    return F.coalesce(F.arrays_overlap(column, literals), F.lit(False))


def clause(df: DataFrame, field: str, operator: str, value: object) -> Column:
    """One filter; an unknown operator is an error."""
    if operator in ("==", "!=", "<", "<=", ">", ">="):
        return where_compare(df, field, operator, value)
    builders = {
        "in": where_in,
        "not-in": where_not_in,
        "array-contains": where_array_contains,
        "array-contains-any": where_array_contains_any,
    }
    if operator not in builders:
        raise ValueError(f"unknown operator: {operator}")
    return builders[operator](df, field, value)


def where_and(df: DataFrame, clauses: Sequence[Clause]) -> Column:
    return reduce(and_, [clause(df, *c) for c in clauses])


def where_composite(df: DataFrame, op: str, clauses: Sequence[Clause]) -> Column:
    """A flat AND or OR group."""
    if op not in ("AND", "OR"):
        raise ValueError(f"unknown composite operator: {op}")
    return reduce(and_ if op == "AND" else or_, [clause(df, *c) for c in clauses])


def where_unary(df: DataFrame, field: str, op: str) -> Column:
    column, _ = _resolve(df, field)
    if op == "IS_NULL":
        return column.isNull()
    if op == "IS_NOT_NULL":
        return column.isNotNull()
    raise ValueError(f"unknown unary operator: {op}")


def effective_filter(
    df: DataFrame,
    where: Sequence[Clause] | None = None,
    composite: tuple[str, Sequence[Clause]] | None = None,
    unary: tuple[str, str] | None = None,
) -> Column | None:
    """Only one kind of filter counts: unary beats composite beats where."""
    if unary:
        return where_unary(df, *unary)
    if composite:
        return where_composite(df, *composite)
    return where_and(df, where) if where else None


def where_cli_string(df: DataFrame, text: str, coerce: bool = False) -> Column:
    """A ``field,op,value`` argument. The value stays text, so it only matches text,
    unless ``coerce`` compares the field's text form with it. Operators on lists are
    refused, as a text is no list."""
    parts = [part.strip() for part in text.split(",")]
    if len(parts) < 3:
        raise ValueError(f"expected field,op,value: {text}")
    field, operator, value = parts[:3]
    if not coerce:
        return clause(df, field, operator, value)
    column, _ = _resolve(df, field)
    shown = df.select(column.cast("string").alias(field))
    if operator in ("==", "!=", "<", "<=", ">", ">="):
        compared = {
            "==": column.cast("string") == value,
            "!=": column.cast("string") != value,
            "<": column.cast("string") < value,
            "<=": column.cast("string") <= value,
            ">": column.cast("string") > value,
            ">=": column.cast("string") >= value,
        }[operator]
        return column.isNotNull() & compared
    return clause(shown, field, operator, value)


def drop_empty_results(results: DataFrame, document: str = "document") -> DataFrame:
    """Drop result items that carry no document."""
    return results.where(F.col(document).isNotNull())


# ------------------------------------------------------------ order and paging


def directions(order_by: Sequence[tuple[str, str]], id_col: str) -> list[tuple[str, bool]]:
    """Order keys with their descending flag; the id makes the order total."""
    keys = [(name, direction.lower() == "desc") for name, direction in order_by]
    for name, direction in order_by:
        if direction.lower() not in ("asc", "desc"):
            raise ValueError(f"unknown direction of {name}: {direction}")
    if id_col not in [name for name, _ in keys]:
        keys.append((id_col, False))
    return keys


def _order_columns(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> list[Column]:
    return [
        _resolve(df, n)[0].desc_nulls_last() if down else _resolve(df, n)[0].asc_nulls_first()
        for n, down in keys
    ]


def _with_order_fields(df: DataFrame, order_by: Sequence[tuple[str, str]]) -> DataFrame:
    present = [_resolve(df, name)[0].isNotNull() for name, _ in order_by]
    return df.where(reduce(and_, present)) if present else df


def order_by(df: DataFrame, order: Sequence[tuple[str, str]], id_col: str = "id") -> DataFrame:
    """Sort by several keys; rows without one of the fields are dropped."""
    kept = _with_order_fields(df, order)
    return kept.orderBy(*_order_columns(kept, directions(order, id_col)))


def past_cursor(
    df: DataFrame, keys: Sequence[tuple[str, bool]], values: Sequence[object], inclusive: bool
) -> Column:
    """Rows at or after a position in the order, compared key by key."""
    reached = F.lit(inclusive)
    for (name, down), value in reversed(list(zip(keys, values))):
        column, kind = _resolve(df, name)
        literal = F.lit(value).cast(kind)
        further = column < literal if down else column > literal
        reached = further | ((column == literal) & reached)
    # the leading key alone is implied, and reaches the scan as a pushed filter
    name, down = keys[0]
    column, kind = _resolve(df, name)
    edge = F.lit(values[0]).cast(kind)
    return (column <= edge if down else column >= edge) & reached


def before_cursor(
    df: DataFrame, keys: Sequence[tuple[str, bool]], values: Sequence[object], inclusive: bool
) -> Column:
    flipped = [(name, not down) for name, down in keys]
    return past_cursor(df, flipped, values, inclusive)


def cursor_filter(
    df: DataFrame,
    keys: Sequence[tuple[str, bool]],
    start_at: Sequence[object] | None = None,
    start_after: Sequence[object] | None = None,
    end_at: Sequence[object] | None = None,
    end_before: Sequence[object] | None = None,
) -> DataFrame:
    if start_at:
        df = df.where(past_cursor(df, keys, start_at, True))
    if start_after:
        df = df.where(past_cursor(df, keys, start_after, False))
    if end_at:
        df = df.where(before_cursor(df, keys, end_at, True))
    if end_before:
        df = df.where(before_cursor(df, keys, end_before, False))
    return df


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def page(
    df: DataFrame, keys: Sequence[tuple[str, bool]], offset: int = 0, limit: int = 0
) -> DataFrame:
    """Skip ``offset`` rows and keep ``limit`` (0 means all) in the given order.

    A short page is a top-k. Anything longer would pass through one task, so the keys
    of the first and last row are looked up instead and become range predicates. Rows
    with equal keys follow each other by a hash of the whole row, so both ways give the
    same rows; of wholly equal rows the page holds the right number.
    """
    if not offset and not limit:
        return df.orderBy(*_order_columns(df, keys))
    whole = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    names = df.columns
    df = df.withColumn(_TIE, F.xxhash64(*whole) if whole else F.lit(0).cast("long"))
    keys = [*keys, (_TIE, False)]
    if limit and offset + limit <= MAX_TOP_ROWS:
        ordered = df.orderBy(*_order_columns(df, keys))
        return (ordered.offset(offset) if offset else ordered).limit(limit).select(*names)
    kept = _rows_between(df, keys, offset, offset + limit if limit else None)
    return kept.orderBy(*_order_columns(kept, keys)).select(*names)


def _rows_between(
    df: DataFrame, keys: Sequence[tuple[str, bool]], start: int, end: int | None
) -> DataFrame:
    """The rows at positions from ``start`` up to ``end`` in the order of the keys."""
    order = KeyOrder(df, keys)
    found = select_ranks(df, order, [start] + ([end] if end is not None else []))
    if start not in found:
        return df.where(F.lit(False))

    def some_of(place: Place, first: int, last: int | None) -> DataFrame:
        """Of the rows equal to one, those from the first up to the last."""
        numbered = global_index(df.where(order.equals(place.values)), [F.col(_TIE)], _POSITION)
        wanted = F.col(_POSITION) >= first
        if last is not None:
            wanted = wanted & (F.col(_POSITION) < last)
        return numbered.where(wanted).drop(_POSITION)

    first, last = found[start], found.get(end)
    at = first.before
    if last is not None and last.before == first.before:
        return some_of(first, start - at, end - at)
    # wholly equal rows at either end are counted out, all others are a range
    beyond = order.beyond(first.values, True)
    inside = df.where(beyond | order.equals(first.values) if start == at else beyond)
    if last is not None:
        inside = inside.where(order.beyond(last.values, False))
    if start > at:
        inside = inside.unionByName(some_of(first, start - at, None))
    if last is not None and (rest := end - last.before):
        inside = inside.unionByName(some_of(last, 0, rest))
    return inside


def select_fields(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """Only the id and the listed fields; a nested field keeps its dotted name."""
    picked = [_resolve(df, name)[0].alias(name) for name in fields if name != id_col]
    return df.select(F.col(id_col), *picked)


# ------------------------------------------------------------------- the query


def doc_query(
    df: DataFrame,
    where: Sequence[Clause] | None = None,
    composite: tuple[str, Sequence[Clause]] | None = None,
    unary: tuple[str, str] | None = None,
    order: Sequence[tuple[str, str]] | None = None,
    limit: int | None = None,
    offset: int | None = None,
    start_at: Sequence[object] | None = None,
    start_after: Sequence[object] | None = None,
    end_at: Sequence[object] | None = None,
    end_before: Sequence[object] | None = None,
    select: Sequence[str] | None = None,
    id_col: str = "id",
) -> DataFrame:
    condition = effective_filter(df, where, composite, unary)
    if condition is not None:
        df = df.where(condition)
    df = _with_order_fields(df, order or [])
    keys = directions(order or [], id_col)
    df = cursor_filter(df, keys, start_at, start_after, end_at, end_before)
    if order or limit or offset:
        df = page(df, keys, offset or 0, limit or 0)
    return select_fields(df, select, id_col) if select else df


def from_options(df: DataFrame, options: dict, id_col: str = "id") -> DataFrame:
    """``doc_query`` from the option object of a document client."""

    def clauses(items: Sequence[dict]) -> list[Clause]:
        return [(i["field"], i["operator"], i["value"]) for i in items]

    composite, unary = options.get("compositeFilter"), options.get("unaryFilter")
    return doc_query(
        df,
        where=clauses(options.get("where") or []),
        composite=(composite["op"], clauses(composite["filters"])) if composite else None,
        unary=(unary["field"], unary["op"]) if unary else None,
        order=[(o["field"], o["direction"]) for o in options.get("orderBy") or []],
        limit=options.get("limit"),
        offset=options.get("offset"),
        start_at=options.get("startAt"),
        start_after=options.get("startAfter"),
        end_at=options.get("endAt"),
        end_before=options.get("endBefore"),
        select=options.get("select"),
        id_col=id_col,
    )


def preview(df: DataFrame, order: Sequence[str], n: int | None = 5) -> DataFrame:
    """The first ``n`` rows (all for None) in the order of some columns, with the number
    of rows left out."""
    keys = [(name, False) for name in order]
    if n is None:
        return df.orderBy(*_order_columns(df, keys)).withColumn("more", F.lit(0).cast("long"))
    left = F.greatest(df.select(F.count("*")).scalar() - n, F.lit(0))
    return page(df, keys, limit=n).withColumn("more", left.cast("long"))
