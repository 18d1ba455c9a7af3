"""The builder surface: a lake opens sources, a query collects clauses, and its DataFrame is Catalyst's to plan."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.functions import expr as X
from tarnlake.operators.aggregates import ORDERED, Agg, aggregate
from tarnlake.operators.windows import Bound, Frame, Order, Window, add_windows
from tarnlake.plans import parts
from tarnlake.plans.compile import Compiler, quoted
from tarnlake.plans.resume import Bookmark, fingerprint
from tarnlake.sources import readers


@dataclass(frozen=True)
class Budget:
    """Limits of a query. Files, their bytes and rows are checked when planning; rows of the result when the query's frame,
    groups or rows are asked for, by counting one more than allowed; time while jobs run."""

    max_files: int | None = None
    max_bytes: int | None = None
    max_rows_decoded: int | None = None
    max_output_rows: int | None = None
    max_elapsed_ms: int | None = None
    max_window_partition_rows: int | None = None

    def of_files(self) -> int | None:
        """A limit that needs the list of files, if there is one."""
        return next((x for x in (self.max_files, self.max_bytes, self.max_rows_decoded) if x is not None), None)

    def within(self, df: DataFrame) -> DataFrame:
        """``df``, which must have at most the allowed rows."""
        most = self.max_output_rows
        if most is not None and (n := timed(df.sparkSession, self.max_elapsed_ms, lambda: df.limit(most + 1).count())) > most:
            raise exceeded("max_output_rows", most, n)
        return df


@dataclass(frozen=True)
class Policy:
    """What a query may see: columns, rows (an expression, or a function of the context that gives one) and how many."""

    allowed_columns: tuple[str, ...] | None = None
    row_filter: X.Expr | Callable[[dict], X.Expr] | None = None
    max_limit: int | None = None
    context: dict = field(default_factory=dict)


@dataclass(frozen=True)
class OrderTerm:
    column: str
    direction: str = "asc"
    nulls: str | None = None

    def sql(self) -> Column:
        c = F.col(quoted(self.column))
        last = (self.nulls or ("last" if self.direction == "asc" else "first")) == "last"
        if self.direction == "asc":
            return c.asc_nulls_last() if last else c.asc_nulls_first()
        return c.desc_nulls_last() if last else c.desc_nulls_first()


def order_terms(terms: Any) -> tuple[OrderTerm, ...]:
    """Terms from names, ``(name, direction[, nulls])`` tuples, or terms."""
    out = []
    for t in terms if isinstance(terms, (list, tuple)) and not (isinstance(terms, tuple) and terms and isinstance(terms[0], str) and len(terms) > 1 and terms[1] in ("asc", "desc")) else [terms]:
        term = t if isinstance(t, OrderTerm) else OrderTerm(t) if isinstance(t, str) else OrderTerm(*t)
        if term.direction not in ("asc", "desc") or term.nulls not in (None, "first", "last"):
            raise LakeError("INVALID_QUERY", "an order is asc or desc, with nulls first or last")
        out.append(term)
    return tuple(out)


def exceeded(metric: str, limit: int, actual: int) -> LakeError:
    return LakeError("BUDGET_EXCEEDED", f"{metric} is {actual}, more than {limit}", {"metric": metric, "limit": limit, "actual": actual})


@dataclass(frozen=True)
class Source:
    """Where rows come from: paths, or a DataFrame with the column that tells the order of its rows, if any."""

    path: str | None = None
    hive: bool = False
    frame: DataFrame | None = None
    ordinal: str | None = None
    index: tuple = ()


class Lake:
    """Opens sources under one budget and policy."""

    def __init__(self, spark: SparkSession, budget: Budget | None = None, policy: Policy | None = None, index: list | None = None):
        self.spark, self.budget, self.policy = spark, budget or Budget(), policy or Policy()
        self.index = tuple(index or ())

    def path(self, source: str) -> Query:
        """A file, a folder, or a glob."""
        return Query(self, Source(path=source, index=self.index))

    def hive(self, source: str) -> Query:
        """The same, with partition columns from ``key=value`` folders as text."""
        return Query(self, Source(path=source, hive=True, index=self.index))

    def frame(self, df: DataFrame, ordinal: str | None = None) -> Query:
        """Any DataFrame; ``ordinal`` names a column that orders its rows."""
        return Query(self, Source(frame=df, ordinal=ordinal))

    def rows(self, rows: list[dict], schema: str | None = None, **limits: int) -> Query:
        df = readers.from_rows(self.spark, [r | {"__row": i} for i, r in enumerate(rows)], f"{schema}, __row bigint" if schema else None, **limits)
        return self.frame(df, "__row") if "__row" in df.columns else self.frame(df)

    def csv(self, path: str, **options: Any) -> Query:
        return self.frame(readers.read_csv(self.spark, path, **options))

    def json(self, path: str, format: str = "auto") -> Query:
        return self.frame(readers.read_json(self.spark, path, format))

    def arrow(self, table: Any) -> Query:
        return self.frame(readers.read_arrow(self.spark, table))

    def query(self, spec: dict | str) -> Query:
        """A query from JSON (version 1)."""
        return query_from_json(self, json.loads(spec) if isinstance(spec, str) else spec)

    def sql(self, text: str, **options: Any) -> DataFrame:
        from tarnlake.plans.sql import run_sql

        return run_sql(self.spark, text, **options)

    def resume(self, bookmark: Bookmark) -> tuple[Query, Bookmark]:
        """The query that a bookmark carries, and the bookmark, checked against its present plan."""
        if bookmark.query is None:
            raise LakeError("INVALID_BOOKMARK", "the bookmark carries no query")
        q = self.query(bookmark.query)
        bookmark.check(q.fingerprint())
        return q, bookmark


@dataclass(frozen=True)
class Query:
    """Clauses of a query; each method gives a new one. Clauses apply in the order: where, windows, qualify, order, projection, distinct, offset, limit."""

    lake: Lake
    source: Source
    columns: tuple[str, ...] | None = None
    computed: tuple[tuple[str, X.Expr], ...] = ()
    condition: X.Expr | None = None
    windows: tuple[tuple[str, Window], ...] = ()
    condition_after: X.Expr | None = None
    order: tuple[OrderTerm, ...] = ()
    unique: bool = False
    most: int | None = None
    skip: int = 0

    def select(self, *columns: str) -> Query:
        names = tuple(columns[0]) if len(columns) == 1 and isinstance(columns[0], (list, tuple)) else columns
        return replace(self, columns=None if names == ("*",) else names)

    def project(self, **computed: X.Expr) -> Query:
        return replace(self, computed=tuple(computed.items()))

    def where(self, condition: X.Expr | dict) -> Query:
        """A repeated call replaces the condition."""
        return replace(self, condition=X.from_json(condition) if isinstance(condition, dict) else condition)

    def window(self, alias: str, window: Window) -> Query:
        return replace(self, windows=(*((a, w) for a, w in self.windows if a != alias), (alias, window)))

    def qualify(self, condition: X.Expr) -> Query:
        return replace(self, condition_after=condition)

    def order_by(self, *terms: Any) -> Query:
        return replace(self, order=order_terms(list(terms)))

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def limit(self, n: int) -> Query:
        return replace(self, most=_count(n, "limit"))

    def offset(self, n: int) -> Query:
        return replace(self, skip=_count(n, "offset"))

    def group_by(self, *columns: str) -> Grouped:
        return Grouped(self, tuple(columns))

    def aggregate(self, spec: dict[str, Agg], **options: Any) -> DataFrame:
        return Grouped(self, ()).aggregate(spec, **options)

    # -- planning

    def files(self) -> list[tuple[str, int]]:
        """The files to read: those of the source that partition values and the index don't rule out."""
        if self.source.path is None:
            return []
        planned = readers.list_files(self.lake.spark, self.source.path)
        if self.source.hive:
            planned = readers.hive_files(planned, _equalities(self.condition))
        if self.source.index:
            from tarnlake.sources.sidecar import prune

            keep = {f["path"] for f in prune(list(self.source.index), self._where())[0]}
            known = {f["path"] for f in self.source.index}
            planned = [f for f in planned if f[0] in keep or f[0] not in known]
        return planned

    def _where(self) -> X.Expr | None:
        rule = self.lake.policy.row_filter
        rule = rule(self.lake.policy.context) if callable(rule) else rule
        return X.and_(rule, self.condition) if rule is not None and self.condition is not None else rule if rule is not None else self.condition

    def _needs_place(self) -> bool:
        return any(w.fn in ("row_number", "ntile", "lag", "lead") or (w.frame and w.frame.mode == "rows") for _, w in self.windows)

    def base(self, place: bool = False) -> tuple[DataFrame, str | None]:
        """The filtered source and the column of its rows' places, if there is one and it is asked for."""
        ordinal = self.source.ordinal
        if self.source.frame is not None:
            df = self.source.frame
        elif not self.source.index and self.lake.budget.of_files() is None:
            # nothing needs the list of files: Spark lists, and prunes folders by conditions on partition columns
            df = readers.read_parquet(self.lake.spark, self.source.path, self.source.hive, place)
            ordinal = readers.FILE_ORDINAL if place else None
        else:
            files, b = self.files(), self.lake.budget
            if b.max_files is not None and len(files) > b.max_files:
                raise exceeded("max_files", b.max_files, len(files))
            if b.max_bytes is not None and (size := sum(n for _, n in files)) > b.max_bytes:
                raise exceeded("max_bytes", b.max_bytes, size)
            if b.max_rows_decoded is not None and files:
                # only footers are read to count rows
                n = readers.read_parquet(self.lake.spark, [p for p, _ in files], self.source.hive, False).count()
                if n > b.max_rows_decoded:
                    raise exceeded("max_rows_decoded", b.max_rows_decoded, n)
            if files:
                df = readers.read_parquet(self.lake.spark, [p for p, _ in files], self.source.hive, place)
            else:  # all files are ruled out: the schema comes from one of them, without rows
                df = readers.read_parquet(self.lake.spark, [readers.list_files(self.lake.spark, self.source.path)[0][0]], self.source.hive, place).limit(0)
            ordinal = readers.FILE_ORDINAL if place else None
        self._check_columns(df)
        where = self._where()
        return (df.filter(Compiler(df).predicate(where)) if where is not None else df), ordinal

    def _check_columns(self, df: DataFrame) -> None:
        allowed = self.lake.policy.allowed_columns
        used = set(self.columns or ()) | X.columns_of(self.condition) | {c for _, e in self.computed for c in X.columns_of(e)}
        aliases = {a for a, _ in self.windows} | {a for a, _ in self.computed}
        used |= {t.column for t in self.order} - aliases
        for _, w in self.windows:
            used |= {c for e in (*w.partition_by, *(o.expr for o in w.order_by), *(a for a in w.args if isinstance(a, X.Expr)), w.where) for c in X.columns_of(e)} | {a for a in w.args if isinstance(a, str) and a != "*"}
        if allowed is not None:
            if self.columns is None and (hidden := [c for c in df.columns if c not in allowed and not c.startswith("__")]) and not self.computed:
                raise LakeError("POLICY_VIOLATION", "the policy doesn't allow all columns", {"columns": hidden})
            if bad := sorted(used - set(allowed) - aliases):
                raise LakeError("POLICY_VIOLATION", f"columns not allowed: {', '.join(bad)}", {"columns": bad})
        for c in self.columns or ():
            if c not in df.columns and c not in aliases:
                raise LakeError("UNKNOWN_COLUMN", f"unknown column {c}", {"column": c, "columns": df.columns})
        if self.source.path is not None:
            readers.reject_unsupported(df.schema if self.columns is None else df.schema, self._shown(df))

    def _shown(self, df: DataFrame) -> list[str]:
        if self.columns is not None:
            return [c for c in self.columns if c in df.columns]
        return [] if self.computed else [c for c in df.columns if not c.startswith("__")]

    def df(self) -> DataFrame:
        """The query as a lazy DataFrame; a limit of its rows is checked here."""
        return self.lake.budget.within(self._built())

    def _built(self, cut: bool = True) -> DataFrame:
        """Without ``cut`` all rows, in no order."""
        df, ordinal = self.base(self._needs_place())
        if self.windows:
            guard = self.lake.budget.max_window_partition_rows
            if guard is not None:
                for w in {w.partition_by: w for _, w in self.windows}.values():
                    keys = [Compiler(df, False).column(p) for p in w.partition_by]
                    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
                    if most > guard:
                        raise exceeded("max_window_partition_rows", guard, most)
            df = add_windows(df, dict(self.windows), ordinal)
        if self.condition_after is not None:
            df = df.filter(Compiler(df, False).predicate(self.condition_after))
        compiler = Compiler(df, False)
        names = [c for c in (self.columns if self.columns is not None else () if self.computed else df.columns) if not c.startswith("__")]
        names += [a for a, _ in self.windows if a not in names and self.columns is None]
        shown = {c: F.col(quoted(c)) for c in names} | {a: compiler.column(e) for a, e in self.computed}
        order = [OrderTerm(f"__o{i}", t.direction, t.nulls) for i, t in enumerate(self.order)]
        hidden = {}
        for o, t in zip(order, self.order):
            if t.column not in df.columns and t.column not in dict(self.computed):
                raise LakeError("UNKNOWN_COLUMN", f"unknown column {t.column}", {"column": t.column})
            if t.column in df.columns and df.schema[t.column].dataType.typeName() in ("array", "map", "struct", "variant"):
                raise LakeError("TYPE_ERROR", f"{t.column} isn't a scalar that rows can be sorted by", {"column": t.column})
            hidden[o.column] = F.col(quoted(t.column)) if t.column in df.columns else shown[t.column]
        out = df.select(*[c.alias(n) for n, c in (shown | hidden).items()])
        if self.unique:
            if order:
                first = F.row_number().over(W.partitionBy(*map(quoted, shown)).orderBy(*[o.sql() for o in order]))
                out = out.withColumn("__first", first).filter("__first = 1").drop("__first")
            else:
                out = out.distinct()
        if not cut:
            return out.drop(*hidden)
        if order:
            out = out.orderBy(*[o.sql() for o in order])
        if self.skip:
            out = out.offset(self.skip)
        most = min((n for n in (self.most, self.lake.policy.max_limit) if n is not None), default=None)
        if most is not None:
            out = out.limit(most)
        return out.drop(*hidden)

    def plan(self) -> dict:
        """The query as plain data; equal plans have equal fingerprints."""
        return {
            "source": self.source.path,
            "hive": self.source.hive,
            "select": self.columns,
            "projections": {a: X.to_json(e) for a, e in self.computed},
            "where": X.to_json(w) if (w := self._where()) is not None else None,
            "windows": {a: repr(w) for a, w in self.windows},
            "qualify": X.to_json(self.condition_after) if self.condition_after is not None else None,
            "orderBy": [[t.column, t.direction, t.nulls] for t in self.order],
            "distinct": self.unique,
            "limit": self.most,
            "offset": self.skip,
        }

    def fingerprint(self) -> str:
        return fingerprint(self.plan())

    def to_json(self) -> dict:
        """The query in its JSON form, if it has one (no projections or windows)."""
        if self.computed or self.windows or self.source.path is None or self.source.hive:
            raise LakeError("INVALID_QUERY", "the query has no JSON form")
        d = {"version": 1, "from": self.source.path, "distinct": self.unique, "offset": self.skip, "orderBy": [{"column": t.column, "direction": t.direction} | ({"nulls": t.nulls} if t.nulls else {}) for t in self.order]}
        d |= {"select": list(self.columns)} if self.columns is not None else {}
        d |= {"where": X.to_json(self.condition)} if self.condition is not None else {}
        return d | ({"limit": self.most} if self.most is not None else {})

    def to_sql(self) -> str:
        """The query as text of the SQL surface, which ``run_sql`` takes back."""
        name = lambda c: X.to_sql(X.col(c))
        head = [name(c) for c in self.columns or ()] or ([] if self.computed else ["*"])
        head += [f"{X.to_sql(e)} AS {name(a)}" for a, e in self.computed]
        head += [f"{_window_sql(w)} AS {name(a)}" for a, w in self.windows if self.columns is None]
        hidden = [(a, w) for a, w in self.windows if self.columns is not None]
        if any(a in (self.columns or ()) for a, _ in hidden):
            head = [f"{_window_sql(dict(hidden)[c])} AS {name(c)}" if c in dict(hidden) else h for c, h in zip(self.columns or (), head)]
            hidden = [(a, w) for a, w in hidden if a not in self.columns]
        if hidden or self.source.path is None:
            raise LakeError("INVALID_QUERY", "the query has no SQL text")
        text = f"SELECT {'DISTINCT ' * self.unique}{', '.join(head)} FROM read_parquet({X.to_sql(X.lit(self.source.path))})"
        text += f" WHERE {X.to_sql(w)}" if (w := self._where()) is not None else ""
        text += f" QUALIFY {X.to_sql(self.condition_after)}" if self.condition_after is not None else ""
        if self.order:
            text += " ORDER BY " + ", ".join(f"{name(t.column)} {t.direction.upper()} NULLS {(t.nulls or ('last' if t.direction == 'asc' else 'first')).upper()}" for t in self.order)
        text += f" LIMIT {self.most}" if self.most is not None else ""
        return text + (f" OFFSET {self.skip}" if self.skip else "")

    # -- results

    def _guarded(self, run: Callable[[DataFrame], Any]) -> Any:
        """Run under the time and row limits."""
        return timed(self.lake.spark, self.lake.budget.max_elapsed_ms, lambda df=self.df(): run(df))

    def to_array(self) -> list[dict]:
        return self._guarded(lambda df: [r.asDict(recursive=True) for r in df.collect()])

    def first(self) -> dict | None:
        row = (self.limit(1) if self.most is None else self)._guarded(lambda df: df.first())
        return row.asDict(recursive=True) if row else None

    def count(self) -> int:
        return self._guarded(lambda df: df.count())

    def rows(self) -> Iterator[dict]:
        for batch in self.batches():
            yield from batch

    def batches(self, size: int = 4096) -> Iterator[list[dict]]:
        began, limit = time.time(), self.lake.budget.max_elapsed_ms
        for batch in readers.read_batches(self.df(), size):
            if limit is not None and (passed := round(1000 * (time.time() - began))) > limit:
                raise exceeded("max_elapsed_ms", limit, passed)
            yield batch

    def slice(self, n: int, bookmark: Bookmark | None = None) -> tuple[list[dict], Bookmark | None]:
        """The next ``n`` rows after a bookmark of the same plan, and the bookmark after them (None at the end).

        The rows must have a total order: the given one, made total by all shown columns. A slice begins behind the keys
        of the last row read, so that each costs a top-n and not a sort of all rows; where these keys can't be carried
        (times, decimals, an order by a column that isn't shown), rows before are passed over.
        """
        print_ = self.fingerprint()
        if bookmark:
            bookmark.check(print_)
        at = bookmark.row_offset if bookmark else 0
        named, shown = {t.column for t in self.order}, [c for c in (self.columns or self.base()[0].columns) if not c.startswith("__")]
        total = replace(self, order=(*self.order, *(OrderTerm(c) for c in shown if c not in named)))
        left = None if self.most is None else max(0, self.most - at)
        take = n if left is None else min(n, left)
        after = bookmark.after if bookmark else None
        if after:
            df = replace(total, skip=0, most=None)._built().filter(_from(total.order, after["keys"])).offset(after["repeats"]).limit(take + 1)
            limit = self.lake.budget.max_elapsed_ms
            found = timed(self.lake.spark, limit, lambda: [r.asDict(recursive=True) for r in self.lake.budget.within(df).collect()])
        else:
            found = replace(total, skip=self.skip + at, most=take + 1).to_array()
        more = len(found) > take and take == n and (left is None or left > n)
        if not more:
            return found[:take], None
        keys = [[r.get(t.column) for t in total.order] for r in found[:take]]
        reached = None
        if keys and all(t.column in found[0] for t in total.order) and all(v is None or isinstance(v, (str, int, float)) and v == v for v in keys[-1]):
            repeats = next((i for i, k in enumerate(reversed(keys)) if k != keys[-1]), len(keys))
            if after and repeats == len(keys) and after["keys"] == keys[-1]:
                repeats += after["repeats"]
            reached = {"keys": keys[-1], "repeats": repeats}
        return found[:take], Bookmark(print_, at + take, query=self._carried(), after=reached)

    def _carried(self) -> dict | None:
        return self.to_json() if self.source.path and not (self.computed or self.windows or self.source.hive) else None

    def part(self, n: int, bookmark: Bookmark | None = None) -> tuple[DataFrame, Bookmark | None]:
        """The rows of ``slice`` as a DataFrame, in no order, and the bookmark after them, which ``slice`` takes too.

        Of its rows only the last one's sort keys reach the driver, so a part may be of any size. The order is made total by
        all columns; those that it names must be shown. Rows that are equal in all of them are told apart by their number.
        Where the keys can't be carried (times, decimals, computed columns), they are found again from the bookmark's position.
        """
        print_ = self.fingerprint()
        if bookmark:
            bookmark.check(print_)
        at, n, rows = bookmark.row_offset if bookmark else 0, _count(n, "n"), self._built(False)
        order = (*self.order, *(OrderTerm(c) for c in rows.columns if c not in {t.column for t in self.order}))
        for t in order:
            if t.column not in rows.columns:
                raise LakeError("INVALID_QUERY", f"parts are cut by columns that the query shows, and {t.column} isn't shown", {"column": t.column})
            if rows.schema[t.column].dataType.typeName() in ("array", "map", "struct", "variant"):
                raise LakeError("TYPE_ERROR", f"{t.column} isn't a scalar that rows can be sorted by", {"column": t.column})
        most = min((m for m in (self.most, self.lake.policy.max_limit) if m is not None), default=None)
        left = None if most is None else max(0, most - at)
        take = n if left is None else min(n, left)
        alike = not (self.computed or self.windows)  # else a slice has other sort keys
        types = [rows.schema[t.column].dataType for t in order]
        values = lambda keys: [None if v is None else parts.typed(v, k) for v, k in zip(keys, types)]
        reach = lambda df, k: parts.reached(df, [t.column for t in order], [t.sql() for t in order], k)
        copies = lambda keys, k: parts.copies(rows.schema, {t.column: v for t, v in zip(order, keys)}, k, rows)

        def found() -> tuple[DataFrame, bool, parts.Reached | None]:
            after, passed = bookmark.after if bookmark and alike else None, self.skip + at
            begun = parts.Reached(after["keys"], after["repeats"]) if after else reach(rows, passed) if passed else None
            if passed and begun is None:
                return rows.limit(0), False, None
            read, ahead, same = 0, rows, F.lit(False)
            if begun:
                read, ahead, same = begun.repeats, rows.filter(_from(order, values(begun.keys))), _same(order, values(begun.keys))
            total, equal = ahead.agg(F.count(F.lit(1)), F.count_if(same)).first()
            stop = read + take  # numbers count from the first of the rows ahead, of which some are equal to the last one read
            if total > stop and stop <= equal:
                return (copies(begun.keys, take) if begun else rows.limit(0)), True, begun and begun._replace(repeats=stop)
            out, end = ahead.filter(~same), None
            if total > stop:
                end = reach(ahead, stop)
                before, last = ~_from(order, values(end.keys)), _same(order, values(end.keys))
                out = out.filter(before | last) if end.repeats == end.copies else out.filter(before).unionByName(copies(end.keys, end.repeats))
            return (out.unionByName(copies(begun.keys, equal - read)) if begun and equal > read else out), end is not None, end

        out, more, end = timed(self.lake.spark, self.lake.budget.max_elapsed_ms, found)
        out = self.lake.budget.within(out)
        if not more or take < n or left is not None and left <= n:
            return out, None
        kept = end and alike and all(isinstance(k, parts.PLAIN) for k in types) and all(v == v for v in end.keys)
        return out, Bookmark(print_, at + take, query=self._carried(), after={"keys": list(end.keys), "repeats": end.repeats} if kept else None)

    def resumable(self, n: int) -> Iterator[tuple[list[dict], Bookmark | None]]:
        mark: Bookmark | None = None
        while True:
            rows, mark = self.slice(n, mark)
            yield rows, mark
            if mark is None:
                return

    def explain(self) -> dict:
        """Files planned and skipped, columns read, where the condition can be decided, and Spark's plan."""
        every = readers.list_files(self.lake.spark, self.source.path) if self.source.path else []
        planned = self.files()
        df = self.df()
        return {
            "filesPlanned": len(planned),
            "filesSkipped": len(every) - len(planned),
            "bytesPlanned": sum(n for _, n in planned),
            "projectedColumns": sorted(set(self.columns or ()) | X.columns_of(self._where()) | {t.column for t in self.order}),
            "predicate": classify(self._where(), set(_equalities(self.condition)) if self.source.hive else set()),
            "fingerprint": self.fingerprint(),
            "plan": df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),
        }

    def analyze(self) -> dict:
        began = time.time()
        n = self.count()
        return self.explain() | {"rows": n, "elapsedMs": round(1000 * (time.time() - began))}


def _from(order: tuple[OrderTerm, ...], keys: list) -> Column:
    """Whether a row has just these sort keys or comes after them."""
    found = F.lit(True)
    for t, v in reversed(list(zip(order, keys))):
        c, last = F.col(quoted(t.column)), (t.nulls or ("last" if t.direction == "asc" else "first")) == "last"
        if v is None:
            beyond = F.lit(False) if last else c.isNotNull()
        else:
            beyond = c > F.lit(v) if t.direction == "asc" else c < F.lit(v)
            beyond = F.coalesce(beyond, F.lit(last))  # only a null isn't compared
        found = beyond | (c.eqNullSafe(F.lit(v)) & found)
    return found


def _same(order: tuple[OrderTerm, ...], keys: list) -> Column:
    """Whether a row has just these sort keys."""
    found = F.lit(True)
    for t, v in zip(order, keys):
        found &= F.col(quoted(t.column)).eqNullSafe(F.lit(v))
    return found


def _count(n: Any, what: str) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise LakeError("INVALID_QUERY", f"{what} must be a whole number from 0")
    return n


def _equalities(e: X.Expr | None) -> dict[str, str]:
    """Columns that must equal a text, as partition values do."""
    if isinstance(e, X.Logical) and e.op == "and":
        return {k: v for x in e.operands for k, v in _equalities(x).items()}
    if isinstance(e, X.Compare) and e.op == "eq" and isinstance(e.left, X.ColumnRef) and isinstance(e.right, X.Literal) and isinstance(e.right.value, str):
        return {e.left.name: e.right.value}
    return {}


def classify(e: X.Expr | None, partition: set[str]) -> dict[str, list[str]]:
    """Each conjunct by who can decide it: partition values, statistics of files and row groups, or rows alone."""
    out: dict[str, list[str]] = {"partition": [], "statistics": [], "residual": []}
    for x in e.operands if isinstance(e, X.Logical) and e.op == "and" else [e] if e is not None else []:
        columns = X.columns_of(x)
        statistics = isinstance(x, (X.Compare, X.In, X.Between, X.NullCheck)) and all(isinstance(y, (X.ColumnRef, X.Literal)) for y in vars(x).values() if isinstance(y, X.Expr))
        out["partition" if columns and columns <= partition else "statistics" if statistics else "residual"].append(X.to_sql(x))
    return out


def _window_sql(w: Window) -> str:
    """A window call as text."""
    from tarnlake.operators.windows import _bound

    args = ", ".join("*" if a == "*" else X.to_sql(X.col(a) if isinstance(a, str) else a) for a in w.args)
    text = f"{w.fn}({'DISTINCT ' * w.distinct}{args}{' IGNORE NULLS' * w.ignore_nulls})"
    text += f" FILTER (WHERE {X.to_sql(w.where)})" if w.where is not None else ""
    parts = [f"PARTITION BY {', '.join(map(X.to_sql, w.partition_by))}"] if w.partition_by else []
    if w.order_by:
        parts.append("ORDER BY " + ", ".join(f"{X.to_sql(o.expr)} {o.direction.upper()} NULLS {(o.nulls or ('last' if o.direction == 'asc' else 'first')).upper()}" for o in w.order_by))
    if w.frame:
        exclude = {"no-others": "", "current-row": " EXCLUDE CURRENT ROW", "group": " EXCLUDE GROUP", "ties": " EXCLUDE TIES"}[w.frame.exclude]
        parts.append(f"{w.frame.mode.upper()} BETWEEN {_bound(w.frame.start)} AND {_bound(w.frame.end)}{exclude}")
    return f"{text} OVER ({' '.join(parts)})"


def timed(spark: SparkSession, limit_ms: int | None, run: Callable[[], Any]) -> Any:
    """Run, and cancel the jobs of this call when the time is over."""
    if limit_ms is None:
        return run()
    tag = f"tarnlake-{time.time_ns()}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(limit_ms / 1000):
            return
        late.set()
        while not done.wait(0.05):  # a job may begin after the time is over
            spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    began = time.time()
    try:
        result = run()
    except Exception:
        if not late.is_set():
            raise
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)
    if late.is_set():
        raise exceeded("max_elapsed_ms", limit_ms, round(1000 * (time.time() - began)))
    return result


@dataclass(frozen=True)
class Grouped:
    """Groups of a query's rows."""

    query: Query
    keys: tuple[str, ...]

    def aggregate(self, spec: dict[str, Agg], having: X.Expr | None = None, order_by: Any = (), limit: int | None = None, offset: int = 0, max_groups: int | None = None, select: list[str] | None = None, distinct: bool = False) -> DataFrame:
        """One row per group; ``having`` and ``order_by`` may name keys and aggregates. ``select`` keeps some of them, and ``distinct`` the different rows of those."""
        q = self.query
        df, ordinal = q.base(any(a.op in ORDERED for a in spec.values()))
        out = aggregate(df, list(self.keys), spec, ordinal)
        if max_groups is not None and out.select(*map(quoted, self.keys)).limit(max_groups + 1).count() > max_groups:
            raise LakeError("GROUP_LIMIT_EXCEEDED", f"more than {max_groups} groups", {"limit": max_groups})
        if having is not None:
            out = out.filter(Compiler(out, False).predicate(having))
        terms = order_terms(order_by) if order_by else ()
        if distinct:
            shown = list(map(quoted, select or out.columns))
            if any(quoted(t.column) not in shown for t in terms):
                raise LakeError("INVALID_QUERY", "distinct groups are ordered by what they show")
            out = out.select(*shown).distinct()
        if terms:
            out = out.orderBy(*[t.sql() for t in terms])
        if select:
            out = out.select(*map(quoted, select))
        if offset:
            out = out.offset(_count(offset, "offset"))
        most = min((n for n in (limit, q.lake.policy.max_limit) if n is not None), default=None)
        return q.lake.budget.within(out if most is None else out.limit(_count(most, "limit")))


# --- JSON ---------------------------------------------------------------------------------------------------------


def _parse(condition: bool, message: str) -> None:
    if not condition:
        raise LakeError("PARSE_ERROR", message)


def query_from_json(lake: Lake, d: Any) -> Query:
    _parse(isinstance(d, dict), "a JSON query must be an object")
    _parse(d.get("version") == 1, "the version must be 1")
    _parse(isinstance(d.get("from"), str), "from must be text")
    unknown = set(d) - {"version", "from", "select", "where", "windows", "qualify", "distinct", "orderBy", "limit", "offset"}
    _parse(not unknown, f"unknown fields: {', '.join(sorted(unknown))}")
    q = lake.path(d["from"])
    if "select" in d:
        _parse(isinstance(d["select"], list) and all(isinstance(c, str) for c in d["select"]), "select must be a list of names")
        q = q.select(*d["select"])
    if "where" in d:
        q = q.where(X.from_json(d["where"]))
    for alias, w in d.get("windows", {}).items():
        q = q.window(alias, window_from_json(w))
    if "qualify" in d:
        q = q.qualify(X.from_json(d["qualify"]))
    if "distinct" in d:
        _parse(isinstance(d["distinct"], bool), "distinct must be true or false")
        q = q.distinct() if d["distinct"] else q
    if "orderBy" in d:
        _parse(isinstance(d["orderBy"], list) and all(isinstance(t, dict) and isinstance(t.get("column"), str) for t in d["orderBy"]), "orderBy must be a list of terms")
        q = q.order_by(*[OrderTerm(t["column"], t.get("direction", "asc"), t.get("nulls")) for t in d["orderBy"]])
    try:
        q = q.limit(d["limit"]) if "limit" in d else q
        return q.offset(d["offset"]) if "offset" in d else q
    except LakeError as e:
        raise LakeError("PARSE_ERROR", e.message) from e


def window_from_json(d: dict) -> Window:
    """A window from its JSON form: fn (text or {aggregate}), args, over {partitionBy, orderBy, frame}, filter, ignoreNulls, distinct."""
    _parse(isinstance(d, dict) and "fn" in d, "a window must have fn")
    over = d.get("over", {})

    def bound(b: dict, end: bool) -> Bound:
        kind = b.get("kind")
        _parse(kind in ("unbounded-preceding", "preceding", "current-row", "following", "unbounded-following"), "invalid frame bound")
        if kind.startswith("unbounded"):
            return Bound("unbounded", after=kind.endswith("following"))
        if kind == "current-row":
            return Bound("current")
        offset = b.get("offset")
        e = X.from_json(offset) if isinstance(offset, dict) else X.lit(offset)
        return Bound(kind, str(e.value) if isinstance(e, X.Literal) else e)

    f = over.get("frame")
    frame = Frame(f["mode"], bound(f["start"], False), bound(f["end"], True), f.get("exclude", "no-others")) if f else None
    name = d["fn"]["aggregate"] if isinstance(d["fn"], dict) else d["fn"]
    return Window(
        name,
        tuple(X.from_json(a) for a in d.get("args", [])),
        tuple(X.from_json(p) for p in over.get("partitionBy", [])),
        tuple(Order(X.from_json(o["expr"]), o.get("direction", "asc"), o.get("nulls")) for o in over.get("orderBy", [])),
        frame,
        X.from_json(d["filter"]) if d.get("filter") else None,
        bool(d.get("ignoreNulls", False)),
        bool(d.get("distinct", False)),
    )
