"""An analyzed query and its arguments as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowql.functions.aggregates import aggregate
from sparrowql.operators.relational import equi_join, full_range, keep, ordered, take
from sparrowql.plans.analyzer import Agg, Col, Expr, Query
from sparrowql.plans.binder import Interval, Value, arguments, row_bound, value_of
from sparrowql.sources.catalog import Table, kind_of, quoted


def internal(column: Col) -> str:
    """A name without clashes: of a side's column, or of its row id."""
    return f"s{column.side}_rowid" if column.name is None else f"s{column.side}:{column.name}"


def _referenced(query: Query, need_rowids: bool) -> set[Col]:
    exprs: list[Expr | None] = [o.expr for o in query.outputs]
    exprs += [s.expr for s in query.sorts]
    exprs += [p.column for p in query.predicates]
    exprs += [query.group, *(query.join or ())]
    found = {e.arg if isinstance(e, Agg) else e for e in exprs}
    out = {c for c in found if c is not None}
    if need_rowids:
        out |= {rowid(side) for side in range(len(query.tables))}
    return out


def rowid(side: int) -> Col:
    return Col(side, None, T.LongType())


def _side(table: Table, side: int, columns: set[Col]) -> DataFrame:
    """The columns of one side under their internal names."""
    mine = sorted((c for c in columns if c.side == side), key=internal)
    if any(c.name is None for c in mine):
        name = internal(rowid(side))
        frame = table.with_rowid(name)
        return frame.select(*[(F.col(name) if c.name is None else quoted(c.name)).alias(internal(c)) for c in mine])
    return table.frame.select(*[quoted(c.name).alias(internal(c)) for c in mine if c.name])


def column(c: Col):
    return quoted(internal(c))


def _intervals(query: Query, args: Sequence[Value]) -> list[dict[str, tuple]]:
    """For each side, what its comparisons leave of each column."""
    out: list[dict[str, tuple]] = [{} for _ in query.tables]
    for p in query.predicates:
        name = internal(p.column)
        kind, interval = out[p.column.side].setdefault(name, (p.column.type, full_range(p.column.type)))
        interval.narrow(p.op, value_of(p.operand, args))
    return out


def _footer_answers(query: Query) -> bool:
    """Whether counts and extremes of whole files answer the query."""
    table = query.tables[0]
    simple = all(isinstance(o.expr, Agg) and (o.expr.arg is None or o.expr.func in ("min", "max") and o.expr.arg.kind == "int" and o.expr.arg.name) for o in query.outputs)
    return query.shape == "totals" and len(query.tables) == 1 and not query.predicates and table.footer is not None and simple


#: Rows of LIMIT and OFFSET together up to which a query without ORDER BY stops early, rows of a join's
#: left side that it tries, and files that it tries after the first.
EARLY_ROWS, EARLY_LEFT, EARLY_FILES = 10_000, 2_000, 32


def _first_rows(table: Table, of: Callable[[Table], DataFrame], wanted: int) -> tuple[DataFrame, bool] | None:
    """The first rows of one side by row id, and whether these are all that it has; None if the first files don't hold enough.

    They are read now: the first file's splits one after another, until enough
    rows are found, and then the next files together.
    """
    for n in sorted({1, min(EARLY_FILES, len(table.files))}):
        frame = of(table if n == len(table.files) else table.first_files(n))
        if n > 1:
            frame = frame.orderBy(column(rowid(0)))
        rows = frame.limit(wanted).collect()
        if len(rows) == wanted or n == len(table.files):
            return frame.sparkSession.createDataFrame(rows, frame.schema), len(rows) < wanted
    return None


def _early(query: Query, sides: Sequence[DataFrame], of: Callable[[Table], DataFrame], wanted: int) -> DataFrame:
    """The first side, cut to the rows that the query's first ``wanted`` rows come from where these are soon found."""
    table = query.tables[0]
    if not (table.in_order and table.files) or any(kind_of(f.dataType) == "other" for f in sides[0].schema.fields):
        return sides[0]
    found = _first_rows(table, of, wanted if query.join is None else max(EARLY_LEFT, wanted))
    if found is None:
        return sides[0]
    first, complete = found
    if query.join is None or complete:
        return first
    joined = equi_join(first, sides[1], internal(query.join[0]), internal(query.join[1]))
    return first if joined.limit(wanted).count() == wanted else sides[0]


def build(query: Query, args: Sequence[Value] = (), ordered_groups: bool = False) -> DataFrame:
    """The query as a DataFrame; with ``ordered_groups``, groups come in the order of their keys."""
    args = arguments(args, query.n_params)
    limit, offset = row_bound(query.limit, args, "LIMIT"), row_bound(query.offset, args, "OFFSET")
    cut = limit is not None or bool(offset)
    need_rowids = query.shape == "rows" and (cut or bool(query.sorts))
    intervals: list[dict[str, tuple[object, Interval]]] = _intervals(query, args)
    if _footer_answers(query):
        table = query.tables[0]
        named = {c for o in query.outputs if isinstance(o.expr, Agg) and (c := o.expr.arg)}
        source = table.footer.select(*[quoted(c.name).alias(internal(c)) for c in sorted(named, key=internal)])  # type: ignore[union-attr, arg-type]
    else:
        columns = _referenced(query, need_rowids)
        of_side = lambda t, s: keep(_side(t, s, columns), intervals[s])  # type: ignore[arg-type]
        sides = [of_side(t, s) for s, t in enumerate(query.tables)]
        wanted = (limit or 0) + (offset or 0)
        if need_rowids and not query.sorts and limit is not None and 0 < wanted <= EARLY_ROWS:
            sides[0] = _early(query, sides, lambda t: of_side(t, 0), wanted)
        source = sides[0]
        if query.join:
            source = equi_join(sides[0], sides[1], internal(query.join[0]), internal(query.join[1]))
    shape = {"rows": _rows, "groups": _groups, "totals": _totals}[query.shape]
    out = shape(query, source, cut or ordered_groups)
    return take(out, limit, offset)


def _aggregate(a: Agg):
    return aggregate(a.func, column(a.arg) if a.arg else None, a.arg.type if a.arg else None)


def _rows(query: Query, source: DataFrame, _: bool) -> DataFrame:
    keys = [(column(s.expr), s.descending) for s in query.sorts if isinstance(s.expr, Col)]
    ids = [rowid(side) for side in range(len(query.tables))]
    if all(internal(c) in source.columns for c in ids):
        keys += [(column(c), False) for c in ids]
        source = source.orderBy(*ordered(keys))
    return source.select(*[column(o.expr).alias(o.name) for o in query.outputs])  # type: ignore[arg-type]


def _groups(query: Query, source: DataFrame, sort: bool) -> DataFrame:
    exprs = [o.expr for o in query.outputs] + [s.expr for s in query.sorts]
    wanted = list(dict.fromkeys(e for e in exprs if isinstance(e, Agg)))
    names = {a: f"a{k}" for k, a in enumerate(wanted)}
    grouped = source.groupBy(column(query.group).alias("key"))  # type: ignore[arg-type]
    out = grouped.agg(*[_aggregate(a).alias(n) for a, n in names.items()]) if names else grouped.agg(F.count(F.lit(1)).alias("n"))
    of = lambda e: F.col(names[e] if isinstance(e, Agg) else "key")
    if sort or query.sorts:
        out = out.orderBy(*ordered([*[(of(s.expr), s.descending) for s in query.sorts], (F.col("key"), False)]))
    return out.select(*[of(o.expr).alias(o.name) for o in query.outputs])


def _totals(query: Query, source: DataFrame, _: bool) -> DataFrame:
    return source.agg(*[_aggregate(o.expr).alias(o.name) for o in query.outputs])  # type: ignore[arg-type]
