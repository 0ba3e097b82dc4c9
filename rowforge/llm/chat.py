"""Tool calls of conversations: linked to their results, ordered, validated, serialised.

All of it is DataFrame operations; JSON is handled as VARIANT, whose text has its keys
sorted and no spare white space.

* Calls and results meet in a hash join on conversation and identifier. Results are first
  reduced to one per identifier, so a repeated identifier cannot multiply rows.
* A call may need results of other calls. Where every needed call stands earlier, the order
  of the conversation is a topological one. Only conversations in which some call needs a
  later one are ordered anew, in rounds: each takes out the calls whose needs are met. Calls
  left when a round takes none are on a cycle, or need one, and come last.
* A conversation's messages stay rows; no conversation is gathered in one task.

Defined cases: a call without an identifier or whose identifier an earlier call has is
linked with nothing and says so; of several results the first in order counts; arguments
that are null or no JSON object fail validation; a tool without a schema fails it too; a
needed call that does not exist is counted and not waited for; a null conversation is one
conversation; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import group_row_number
from ..session import durable

#: Types of a schema and how a value's type begins.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "(BIGINT|DOUBLE|DECIMAL)",
    "boolean": "BOOLEAN",
    "array": "ARRAY",
    "object": "OBJECT",
}


@dataclass(frozen=True)
class Tool:
    """Arguments of a tool by name and type; any other argument is an error."""

    required: Mapping[str, str] = field(default_factory=dict)
    optional: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name, kind in {**self.required, **self.optional}.items():
            if kind not in TYPES or not name or set(name) & set("'[]\\"):
                raise ValueError(f"argument {name!r} of type {kind!r}")


def _argument_errors(arguments: Column, tool: Tool) -> Column:
    """Errors of the arguments (VARIANT) under one schema, in order of names."""
    checks = []
    for name, kind in sorted({**tool.required, **tool.optional}.items()):
        found = F.schema_of_variant(F.try_variant_get(arguments, f"$['{name}']", "variant"))
        absent = F.lit(f"missing:{name}") if name in tool.required else F.lit(None).cast("string")
        checks.append(
            F.when(found.isNull(), absent).when(~found.rlike(f"^{TYPES[kind]}"), F.lit(f"type:{name}"))
        )
    given = F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>"))
    known = F.array(*[F.lit(n) for n in (*tool.required, *tool.optional)]).cast("array<string>")
    unknown = F.transform(F.array_sort(F.array_except(given, known)), lambda n: F.concat(F.lit("unknown:"), n))
    return F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), unknown)


def argument_errors(name: Column, arguments: Column, tools: Mapping[str, Tool]) -> Column:
    """What is wrong with the arguments of a call; empty if nothing is."""
    is_object = F.coalesce(F.schema_of_variant(arguments).rlike("^OBJECT"), F.lit(False))
    by_tool = F.when(~is_object, F.array(F.lit("not_object")))
    for tool_name in sorted(tools):
        by_tool = by_tool.when(name == tool_name, _argument_errors(arguments, tools[tool_name]))
    return by_tool.otherwise(F.array(F.lit("unknown_tool")))


def tool_messages(turns: DataFrame, conversation: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Calls and results that the texts of turns carry as JSON.

    An assistant's text may be ``{"tool_calls": [{"id", "name", "arguments", "needs"}]}``, a
    tool's ``{"tool_call_id", "content"}``; any other text is prose.
    """
    parsed = turns.select(
        F.col(conversation).alias("conversation"), F.col("turn").cast("long").alias("turn"), "role",
        F.try_parse_json("text").alias("v"),
    )
    calls = (
        parsed.where("role = 'assistant'")
        .select("conversation", "turn", F.posexplode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("place", "c"))
        .select(
            "conversation", "turn", "place",
            F.try_variant_get("c", "$.id", "string").alias("id"),
            F.try_variant_get("c", "$.name", "string").alias("name"),
            F.try_variant_get("c", "$.arguments", "variant").alias("arguments"),
            F.coalesce(F.try_variant_get("c", "$.needs", "array<string>"), F.array().cast("array<string>")).alias("needs"),
        )
    )
    results = (
        parsed.where("role = 'tool'")
        .select(
            "conversation", "turn",
            F.try_variant_get("v", "$.tool_call_id", "string").alias("id"),
            F.try_variant_get("v", "$.content", "string").alias("content"),
        )
        .where("id is not null")
    )
    return calls, results


def exchanges(turns: DataFrame, conversation: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """A conversation in prose as calls and results: every user turn calls ``reply`` with
    its text, needs the call two turns before, and the next turn, if it is an assistant's,
    is its result. Identifiers are conversation and turn."""

    def identifier(turn: Column) -> Column:
        return F.concat_ws(":", F.col("conversation").cast("string"), turn.cast("string"))

    plain = turns.select(
        F.col(conversation).alias("conversation"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    calls = plain.where("role = 'user'").select(
        "conversation", "turn", F.lit(0).alias("place"),
        F.when(F.col("turn").isNotNull(), identifier(F.col("turn"))).alias("id"),
        F.lit("reply").alias("name"),
        F.parse_json(F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(identifier(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = plain.where("role = 'assistant' and turn is not null").select(
        "conversation", "turn", identifier(F.col("turn") - 1).alias("id"), F.col("text").alias("content")
    )
    return calls, results


def _same(left: str, right: str, names: list[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    )


def _levels(edges: DataFrame) -> DataFrame:
    """``conversation, id, level`` of the calls that have to be ordered anew.

    ``edges`` (``conversation, id, needed``) are all edges of their conversations; calls on a
    cycle, and calls that need them, get no level and no row. Calls without edges are free.
    """
    free = None
    level = 0
    while True:
        waiting = edges.select("conversation", "id").distinct()
        ready = (
            edges.select("conversation", F.col("needed").alias("id")).distinct().alias("n")
            .join(waiting.alias("w"), _same("n", "w", ["conversation", "id"]), "left_anti")
        )
        ready = durable(ready.withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return free
        free = ready if free is None else free.union(ready)
        left = edges.alias("e").join(
            ready.select("conversation", F.col("id").alias("needed")).alias("r"),
            _same("e", "r", ["conversation", "needed"]), "left_anti",
        )
        left = durable(left)
        # whoever waits for nothing any more is ready in the next round
        done = waiting.alias("w").join(
            left.select("conversation", "id").distinct().alias("l"), _same("w", "l", ["conversation", "id"]), "left_anti"
        )
        level += 1
        last = durable(done.withColumn("level", F.lit(level)))
        needed_later = left.select("conversation", "needed")
        free = free.union(
            last.alias("d").join(
                needed_later.select("conversation", F.col("needed").alias("id")).distinct().alias("l"),
                _same("d", "l", ["conversation", "id"]), "left_anti",
            )
        )
        edges = left


def link_calls(calls: DataFrame, results: DataFrame, tools: Mapping[str, Tool]) -> DataFrame:
    """Every call with its place, link, errors and canonical JSON.

    ``calls`` holds ``conversation, turn, place, id, name, arguments, needs`` with arguments
    as VARIANT, ``results`` holds ``conversation, turn, id, content``.
    """
    names = ["conversation", "id"]
    # canonical text instead of VARIANT: rows with a VARIANT cannot be compared or grouped
    calls = durable(
        calls.select(
            "conversation", "turn", "place", "id", "name", "needs",
            F.to_json("arguments").alias("arguments"),
            argument_errors(F.col("name"), F.col("arguments"), tools).alias("errors"),
            F.monotonically_increasing_id().alias("call"),
        )
    )
    # the first call of an identifier owns it
    owners = calls.where("id is not null").groupBy(*names).agg(
        F.min(F.struct("turn", "place", "call")).alias("first")
    )
    owners = durable(owners.select(*names, "first.turn", "first.place", "first.call"))
    first_results = results.groupBy(*names).agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results")
    )
    linked = owners.alias("o").join(
        first_results.hint("shuffle_hash").alias("r"), _same("o", "r", names), "left"
    ).select("o.*", "r.result", F.coalesce("r.n_results", F.lit(0)).alias("n_results"))

    needs = calls.alias("c").join(owners.alias("o"), F.col("c.call") == F.col("o.call"), "left_semi")
    needs = needs.select("conversation", "id", "turn", "place", "call", F.explode(F.array_distinct("needs")).alias("needed"))
    target = owners.select(
        "conversation", F.col("id").alias("needed"), F.col("turn").alias("t"), F.col("place").alias("p")
    )
    edges = durable(
        needs.alias("n").join(target.alias("t"), _same("n", "t", ["conversation", "needed"]), "left")
        .select("n.*", F.struct("t.t", "t.p").alias("at"), F.col("t.needed").isNotNull().alias("met"))
    )
    unmet = edges.where("not met").groupBy("call").agg(F.count("*").alias("n_unmet"))
    late = edges.where("met").where(F.col("at") >= F.struct(F.col("turn").alias("t"), F.col("place").alias("p")))
    unordered = durable(late.select("conversation").distinct())
    ordered = calls.join(unmet, "call", "left").join(linked.select("call", "result", "n_results", F.lit(True).alias("owner")), "call", "left")
    if unordered.isEmpty():
        ordered = ordered.withColumns({"level": F.lit(0), "cyclic": F.lit(False)})
    else:
        inside = edges.where("met").alias("e").join(unordered.alias("u"), _same("e", "u", ["conversation"]), "left_semi")
        inside = durable(inside.select("conversation", "id", "needed"))
        levels = _levels(inside)
        stuck = inside.select(*names).distinct()
        stuck = stuck.withColumn("waits", F.lit(True))
        if levels is not None:
            levels = levels.groupBy(*names).agg(F.max("level").alias("level"))
            ordered = ordered.alias("c").join(levels.alias("l"), _same("c", "l", names) & F.col("c.owner"), "left").select("c.*", "l.level")
        else:
            ordered = ordered.withColumn("level", F.lit(None).cast("int"))
        ordered = ordered.alias("c").join(stuck.alias("s"), _same("c", "s", names) & F.col("c.owner"), "left").select("c.*", "s.waits")
        cyclic = F.coalesce("waits", F.lit(False)) & F.col("level").isNull()
        ordered = ordered.withColumn("cyclic", cyclic).withColumn(
            "level", F.when(cyclic, F.lit(2**31 - 1)).otherwise(F.coalesce("level", F.lit(0)))
        ).drop("waits")

    status = (
        F.when(F.col("id").isNull(), "unidentified")
        .when(F.col("owner").isNull(), "repeated")
        .when(F.col("n_results") > 0, "answered")
        .otherwise("pending")
    )
    message = F.to_json(
        F.struct(
            F.struct(F.try_parse_json("arguments").alias("arguments"), "id", "name").alias("call"),
            "errors",
            F.when(F.col("n_results") > 0, F.struct("result.content", "result.turn")).alias("result"),
        )
    )
    placed = group_row_number(
        ordered, ["conversation"], [F.col("level"), F.col("turn"), F.col("place"), F.col("call")], "position"
    )
    return placed.select(
        "conversation",
        "turn",
        "place",
        "position",
        F.col("id").alias("call_id"),
        F.col("name").alias("tool"),
        status.alias("status"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.coalesce("n_unmet", F.lit(0)).cast("long").alias("n_unmet"),
        "cyclic",
        (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", " ").alias("errors"),
        message.alias("message"),
    )
