"""Collections kept as files in key order, with a manifest of the keys in each file.

A store has one or more copies of a collection. Each copy is sorted by its own keys over
range partitions, so a file holds a short range of them; the manifest says which. A query
takes the copy whose keys fit its filter and order best, and opens only the files that its
cursors, its equal or listed leading values, or its limit can touch. The rows then go
through ``doc_query`` as any others, so the result is that of the whole collection.

Files are never changed. A change finds the files that hold the ids concerned, writes the
rows of those files anew, and puts up a manifest in which the new files stand for the old
ones; all others keep their names. A version is a small file that is created once and never
overwritten: a job that fails before leaves the last version as it was, and of two writers
that start from the same version one is refused.

The manifest has one row per file. It is read and filtered as a table; only the names of the
files to open come to the driver, which needs them to plan any scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.docquery import (
    Clause,
    _order_columns,
    _resolve,
    _same_family,
    _with_order_fields,
    before_cursor,
    directions,
    doc_query,
    past_cursor,
)
from ..operators.ranking import global_index
from ..session import durable
from .documents import BATCH_SIZE, ImportFailed, doc_merge
from .files import create_text, list_names, read_text, remove_paths

Order = Sequence[tuple[str, str]]

#: Rows of a file.
ROWS_PER_FILE = 1_000_000


class Conflict(RuntimeError):
    """Another writer has put up a version since this one was read."""


@dataclass(frozen=True)
class _State:
    """What a version file says."""

    version: int
    folder: str  # of the manifests
    schema: T.StructType
    id_col: str
    orders: tuple[tuple[tuple[str, str], ...], ...]  # keys of each copy, without the id
    rows_per_file: int
    ledgers: tuple[str, ...] = ()

    def dumps(self) -> str:
        return json.dumps(
            {
                "version": self.version,
                "folder": self.folder,
                "schema": self.schema.jsonValue(),
                "id_col": self.id_col,
                "orders": self.orders,
                "rows_per_file": self.rows_per_file,
                "ledgers": self.ledgers,
            }
        )

    @classmethod
    def loads(cls, text: str) -> _State | None:
        try:
            raw = json.loads(text)
        except ValueError:  # its writer was lost before it was whole
            return None
        return cls(
            raw["version"],
            raw["folder"],
            T.StructType.fromJson(raw["schema"]),
            raw["id_col"],
            tuple(tuple((f, d) for f, d in order) for order in raw["orders"]),
            raw["rows_per_file"],
            tuple(raw["ledgers"]),
        )


@dataclass(frozen=True)
class _Fit:
    """How a copy serves a query: equal leading values, then keys in the query's order."""

    copy: int
    equal: tuple[object, ...]
    matched: int
    backwards: bool
    listed: tuple[object, ...] | None  # values of an ``in`` on the first key

    @property
    def rank(self) -> tuple[int, int, int]:
        return len(self.equal), self.matched, self.listed is not None


def declared_indexes(text: str) -> dict[str, list[list[tuple[str, str]]]]:
    """Orders per collection from an index declaration file."""
    found: dict[str, list[list[tuple[str, str]]]] = {}
    # fixed values: names and directions of the declaration format
    words = {"ASCENDING": "asc", "DESCENDING": "desc"}
    for index in json.loads(text).get("indexes", []):
        order = [(f["fieldPath"], words[f["order"]]) for f in index["fields"] if "order" in f]
        found.setdefault(index["collectionGroup"], []).append(order)
    return found


class Store:
    """One version of a collection; changes return the next one."""

    def __init__(self, spark: SparkSession, root: str, state: _State):
        self.spark, self.root, self.state = spark, root.rstrip("/"), state

    # ------------------------------------------------------------------ versions

    @classmethod
    def create(
        cls,
        df: DataFrame,
        root: str,
        id_col: str = "id",
        indexes: Sequence[Order] = ((),),
        rows_per_file: int = ROWS_PER_FILE,
    ) -> Store:
        """A new store with a copy for each order; the id ends every order. An order of
        nothing is a copy in the order of ids."""
        orders = tuple(tuple((f, d.lower()) for f, d in order) for order in indexes)
        if not orders:
            raise ValueError("a store needs a copy")
        folder = uuid.uuid4().hex
        store = cls(df.sparkSession, root, _State(0, folder, df.schema, id_col, orders, rows_per_file))
        for copy in range(len(orders)):
            store._write(df, copy, folder, df.count()).write.parquet(store._manifest_path(folder, copy))
        return store._put_up(store.state)

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> Store:
        names = sorted(list_names(spark, f"{root.rstrip('/')}/versions"), reverse=True)
        for name in names:
            if version is None or int(name) == version:
                state = _State.loads(read_text(spark, f"{root.rstrip('/')}/versions/{name}"))
                if state:
                    return cls(spark, root, state)
        raise FileNotFoundError(f"no such version of a store: {root}")

    def _put_up(self, state: _State) -> Store:
        path = f"{self.root}/versions/{state.version:012d}"
        if not create_text(self.spark, path, state.dumps()):
            raise Conflict(f"version {state.version} is there already: {self.root}")
        return Store(self.spark, self.root, state)

    def clean(self) -> list[str]:
        """Removes files and manifests that no longer belong to this version, and the
        versions before it; returns what it removed. Not while older versions are read."""
        live = {r["f"] for c in self._copies for r in self.files(c).select(F.col("file").alias("f")).collect()}
        gone = []
        for folder in list_names(self.spark, f"{self.root}/data"):
            for copy in list_names(self.spark, f"{self.root}/data/{folder}"):
                names = [n for n in list_names(self.spark, f"{self.root}/data/{folder}/{copy}") if n.startswith("part-")]
                gone += [f"{self.root}/data/{folder}/{copy}/{n}" for n in names if f"{folder}/{copy}/{n}" not in live]
        gone += [f"{self.root}/manifests/{n}" for n in list_names(self.spark, f"{self.root}/manifests") if n != self.state.folder]
        names = list_names(self.spark, f"{self.root}/versions")
        gone += [f"{self.root}/versions/{n}" for n in names if int(n) < self.state.version]
        remove_paths(self.spark, gone)
        return gone

    # --------------------------------------------------------------------- files

    @property
    def _copies(self) -> range:
        return range(len(self.state.orders))

    def _keys(self, copy: int) -> list[tuple[str, bool]]:
        return directions(self.state.orders[copy], self.state.id_col)

    def _manifest_path(self, folder: str, copy: int) -> str:
        return f"{self.root}/manifests/{folder}/{copy}"

    def files(self, copy: int = 0) -> DataFrame:
        """The manifest of a copy: ``file, rows, ordered`` (rows with all its fields), and
        the ``first`` and ``last`` keys."""
        return self.spark.read.parquet(self._manifest_path(self.state.folder, copy))

    def _read(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.state.schema)
        return self.spark.read.schema(self.state.schema).parquet(*[f"{self.root}/data/{f}" for f in files])

    def _names(self, files: DataFrame) -> list[str]:
        return [r["file"] for r in files.select("file").orderBy("file").collect()]

    def rows(self) -> DataFrame:
        """The whole collection."""
        return self._read(self._names(self.files()))

    def _write(self, df: DataFrame, copy: int, folder: str, rows: int) -> DataFrame:
        """Writes rows in the order of a copy and returns the manifest of the new files."""
        order = _order_columns(df, self._keys(copy))
        parts = max(1, -(-rows // self.state.rows_per_file))
        path = f"{self.root}/data/{folder}/{copy}"
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        keys = F.struct(*[_resolve(written, name)[0].alias(f"k{i}") for i, (name, _) in enumerate(self._keys(copy))])
        place = F.col("_metadata.row_index")
        fields = [_resolve(written, name)[0].isNotNull() for name, _ in self.state.orders[copy]]
        return written.groupBy(F.concat(F.lit(f"{folder}/{copy}/"), F.col("_metadata.file_name")).alias("file")).agg(
            F.count("*").alias("rows"),
            F.count_if(reduce(and_, fields, F.lit(True))).alias("ordered"),
            F.min_by(keys, place).alias("first"),
            F.max_by(keys, place).alias("last"),
        )

    # ------------------------------------------------------------------- queries

    def _fit(self, copy: int, where: Sequence[Clause], order: Order) -> _Fit:
        keys = self._keys(copy)
        schema = self._read([])
        equal: list[object] = []
        same = {f: v for f, op, v in where if op == "==" and v is not None and _same_family(_resolve(schema, f)[1], v)}
        while len(equal) < len(keys) and keys[len(equal)][0] in same:
            equal.append(same[keys[len(equal)][0]])
        rest = keys[len(equal) :]
        wanted = [k for k in directions(order, self.state.id_col) if k[0] not in {n for n, _ in keys[: len(equal)]}]

        def alike(there: list[tuple[str, bool]]) -> int:
            n = 0
            while n < min(len(wanted), len(there)) and wanted[n] == there[n]:
                n += 1
            return n

        forward, back = alike(rest), alike([(name, not down) for name, down in rest])
        listed = None
        if not equal:
            for f, op, values in where:
                if op == "in" and f == keys[0][0] and not isinstance(values, str):
                    listed = tuple(v for v in values if v is not None and _same_family(_resolve(schema, f)[1], v))
        return _Fit(copy, tuple(equal), max(forward, back), back > forward, listed)

    def touched(
        self,
        where: Sequence[Clause] | None = None,
        order: Order | None = None,
        limit: int | None = None,
        offset: int | None = None,
        start_at: Sequence[object] | None = None,
        start_after: Sequence[object] | None = None,
        end_at: Sequence[object] | None = None,
        end_before: Sequence[object] | None = None,
    ) -> tuple[int, DataFrame]:
        """The copy that serves a query, and the part of its manifest it has to read.

        A limit narrows the files only if the leading keys say all that the filter says:
        else it is not known how many rows of a file pass.
        """
        where, order = list(where or []), list(order or [])
        fit = max((self._fit(c, where, order) for c in self._copies), key=lambda f: f.rank)
        keys, n = self._keys(fit.copy), len(fit.equal)
        # in the direction of the query
        keys = [*keys[:n], *((name, down != fit.backwards) for name, down in keys[n:])]
        files = self.files(fit.copy)
        begin, end = ("last", "first") if fit.backwards else ("first", "last")

        def at(side: str) -> list[tuple[str, bool]]:
            return [(f"{side}.k{i}", down) for i, (_, down) in enumerate(keys)]

        def reaches(values: Sequence[object]) -> Column:
            """Files whose last row is at the position or after it."""
            return F.coalesce(past_cursor(files, at(end), values, True), F.lit(True))

        def starts_by(values: Sequence[object]) -> Column:
            """Files whose first row is at the position or before it."""
            return F.coalesce(before_cursor(files, at(begin), values, True), F.lit(True))

        def position(values: Sequence[object]) -> list[object]:
            return [*fit.equal, *list(values)[: fit.matched]]

        if fit.listed is not None:
            ranges = [reaches([v]) & starts_by([v]) for v in fit.listed]
            files = files.where(reduce(or_, ranges, F.lit(False)))
        cursors = [v for v in (start_at, start_after, end_at, end_before) if v]
        lower = [position(v) for v in (start_at, start_after) if v]
        upper = [position(v) for v in (end_at, end_before) if v]
        for name, op, value in where:
            # a bound on the key behind the equal ones
            if n < len(keys) and name == keys[n][0] and op in ("<", "<=", ">", ">=") and value is not None:
                if _same_family(_resolve(self._read([]), name)[1], value):
                    (lower if (op[0] == ">") != keys[n][1] else upper).append([*fit.equal, value])
        # files that hold nothing but rows of the result
        whole = F.lit(True)
        if fit.equal:
            files = files.where(reaches(fit.equal) & starts_by(fit.equal))
            sides = [F.col(f"{side}.k{i}") == F.lit(v) for side in ("first", "last") for i, v in enumerate(fit.equal)]
            whole = F.coalesce(reduce(and_, sides), F.lit(False))
        for values in (v for v in lower if v):
            files = files.where(reaches(values))
            whole = whole & F.coalesce(past_cursor(files, at(begin), values, False), F.lit(False))
        for values in (v for v in upper if v):
            files = files.where(starts_by(values))
            whole = whole & F.coalesce(before_cursor(files, at(end), values, False), F.lit(False))
        leading = {name for name, _ in keys[:n]}
        known = all(op == "==" and name in leading for name, op, _ in where) and (fit.matched or not cursors)
        if limit and known and (fit.matched or not order):
            files = self._first_files(files, whole, at, begin, end, n + fit.matched, limit + (offset or 0))
        return fit.copy, files

    def _first_files(self, files, whole, at, begin, end, n_keys: int, rows: int) -> DataFrame:
        """The files that the first ``rows`` rows can lie in: none that begins after a place
        before which whole files hold so many already."""
        if not n_keys:
            return files
        ends = at(end)[:n_keys]
        by_end = Window.orderBy(*[
            F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in ends
        ]).rowsBetween(Window.unboundedPreceding, 0)
        # one row per file
        running = files.withColumn("through", F.sum(F.when(whole, F.col("ordered")).otherwise(0)).over(by_end))
        bound = running.where(F.col("through") >= rows).orderBy("through").select(*[F.col(c).alias(f"v{i}") for i, (c, _) in enumerate(ends)]).first()
        if bound is None or any(v is None for v in bound):
            return files
        return files.where(F.coalesce(before_cursor(files, at(begin)[:n_keys], list(bound), True), F.lit(True)))

    def query(self, select: Sequence[str] | None = None, **options) -> DataFrame:
        """``doc_query`` with the same options, over the files that it can touch."""
        narrowing = {k: v for k, v in options.items() if k not in ("composite", "unary")}
        if options.get("composite") or options.get("unary"):
            # they beat ``where``, and may hold anywhere; cursors still narrow
            narrowing = {k: v for k, v in narrowing.items() if k not in ("where", "limit", "offset")}
        _, files = self.touched(**narrowing)
        return doc_query(self._read(self._names(files)), select=select, id_col=self.state.id_col, **options)

    def lookup(self, doc_id: object) -> DataFrame:
        """The document of an id, as a frame of one row or none."""
        return self.query(where=[(self.state.id_col, "==", doc_id)]).limit(1)

    # ------------------------------------------------------------------- changes

    def _holding(self, ids: DataFrame, copy: int) -> list[str]:
        """Files of a copy with a row of these ids; reads the ids only."""
        id_col = self.state.id_col
        files = self.files(copy)
        if not self.state.orders[copy]:
            # in the order of ids: files beyond the smallest and largest one are not read
            ends = ids.agg(F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
            if ends["low"] is None:
                return []
            files = files.where((F.col("last.k0") >= ends["low"]) & (F.col("first.k0") <= ends["high"]))
        names = self._names(files)
        if not names:
            return []
        found = self._read(names).select(
            id_col, F.substring_index(F.col("_metadata.file_path"), "/", -3).alias("file")
        )
        return [r["file"] for r in found.join(ids, id_col, "left_semi").select("file").distinct().collect()]

    def _commit(self, ids: DataFrame | None, new: DataFrame | None, **more) -> Store:
        """The next version: without the rows of ``ids``, with the rows ``new``."""
        folder, id_col = uuid.uuid4().hex, self.state.id_col
        added = new.count() if new is not None else 0
        schema = self.state.schema if new is None else new.schema
        here = Store(self.spark, self.root, replace(self.state, schema=schema))
        changed = bool(added)
        for copy in self._copies:
            manifest = self.files(copy)
            hit = self._holding(ids, copy) if ids is not None else []
            changed = changed or bool(hit)
            parts, rows = [], added
            if hit:
                old = manifest.join(F.broadcast(self.spark.createDataFrame([(f,) for f in hit], "file string")), "file", "left_semi")
                rows += old.agg(F.sum("rows")).first()[0]
                parts.append(here._read(hit).join(ids, id_col, "left_anti"))
                manifest = manifest.join(F.broadcast(old.select("file")), "file", "left_anti")
            if added:
                parts.append(new)
            if parts:
                written = here._write(reduce(DataFrame.unionByName, parts), copy, folder, rows)
                manifest = manifest.unionByName(written)
            manifest.write.parquet(self._manifest_path(folder, copy))
        if not changed and not more:
            return self
        return here._put_up(replace(here.state, version=self.state.version + 1, folder=folder, **more))

    def append(self, new: DataFrame) -> Store:
        """With new documents, in files of their own. A field that they lack is null."""
        return self._commit(None, durable(self._read([]).unionByName(new, allowMissingColumns=True)))

    def merge(
        self, updates: DataFrame, supplied: str | None = None, replace: bool = False, upsert: bool = False
    ) -> Store:
        """With the fields that updates supply (see ``doc_merge``); one update per id."""
        updates = durable(updates)
        id_col = self.state.id_col
        ids = updates.select(id_col).distinct()
        old = self._read(self._holding(ids, 0)).join(ids, id_col, "left_semi")
        changed = doc_merge(old, updates, id_col, supplied, replace, upsert)
        # fields keep their order and type; new ones come last
        kinds = {f.name: f.dataType for f in self.state.schema.fields}
        names = [*kinds, *[c for c in changed.columns if c not in kinds]]
        typed = [F.col(f"`{n}`").cast(kinds.get(n, changed.schema[n].dataType)).alias(n) for n in names]
        return self._commit(ids, durable(changed.select(*typed)))

    def delete(self, keys: DataFrame) -> Store:
        """Without the documents of these ids."""
        return self._commit(durable(keys.select(self.state.id_col).distinct()), None)

    # ------------------------------------------------------------------- imports

    def ledger(self) -> DataFrame:
        """Every batch that an import has tried: ``import_id, batch, rows, error``; the error
        is null for those that are in."""
        schema = "import_id string, batch long, rows long, error string, attempt long"
        if not self.state.ledgers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/ledgers/{n}" for n in self.state.ledgers])

    def import_batches(
        self, rows: DataFrame, order: list[Column], import_id: str, error: Column, size: int = BATCH_SIZE
    ) -> Store:
        """Imports rows in batches of ``size`` in the given total order, each as a whole or
        not at all: one row with an ``error`` (null for a good one) keeps its batch out.

        Rows get an id and the time of the import. The same ``import_id`` again tries only
        the batches that are not in yet, and adds none twice: what is in and what failed is
        put up with the rows, in one version. An import of which nothing ever got in is an
        error.
        """
        id_col = self.state.id_col
        staged = durable(
            global_index(rows, order, "__index")
            .withColumn("__batch", F.floor(F.col("__index") / size) + 1)
            .withColumn("__error", error)
        )
        tried = self.ledger().where(F.col("import_id") == import_id)
        there = tried.where("error is null").select(F.col("batch").alias("__batch"))
        todo = staged.join(there, "__batch", "left_anti")
        verdicts = durable(
            todo.groupBy(F.lit(import_id).alias("import_id"), F.col("__batch").alias("batch")).agg(
                F.count("*").alias("rows"),
                F.min_by("__error", F.when(F.col("__error").isNotNull(), F.col("__index"))).alias("error"),
                F.lit(len(self.state.ledgers) + 1).cast("long").alias("attempt"),
            )
        )
        good = verdicts.where("error is null")
        if good.isEmpty() and there.isEmpty():
            raise ImportFailed("no document was imported")
        wanted = good.select(F.col("batch").alias("__batch"))
        # an id hangs on the import and the place of the row, so a repeated task makes the same
        new = (
            todo.join(wanted, "__batch", "left_semi")
            .withColumn(id_col, F.md5(F.concat_ws(":", F.lit(import_id), F.col("__index").cast("string"))))
            .withColumn("importedAt", F.current_timestamp())
        )
        new = durable(self._read([]).unionByName(new.drop("__index", "__batch", "__error"), allowMissingColumns=True))
        name = uuid.uuid4().hex
        verdicts.write.parquet(f"{self.root}/ledgers/{name}")
        return self._commit(None, new, ledgers=(*self.state.ledgers, name))


def import_report(ledger: DataFrame, import_id: str) -> DataFrame:
    """Per batch of an import, after all its attempts: rows in and refused, and why."""
    last = F.max_by(F.struct("rows", "error"), "attempt").alias("last")
    return (
        ledger.where(F.col("import_id") == import_id)
        .groupBy("batch")
        .agg(last, F.count("*").alias("attempts"))
        .select(
            "batch",
            F.when(F.col("last.error").isNull(), F.col("last.rows")).otherwise(0).alias("imported"),
            F.when(F.col("last.error").isNotNull(), F.col("last.rows")).otherwise(0).alias("failed"),
            F.col("last.error").alias("error"),
            "attempts",
        )
    )
