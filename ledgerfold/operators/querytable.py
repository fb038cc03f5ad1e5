"""One declarative interface over any DataFrame: filter, sort, page, group, distinct values and statistics.

A query is plain data that is checked against the dataset's fields on the driver and turned into Columns, so Catalyst
sees ordinary predicates and aggregates. Null, empty text and empty array are the same thing everywhere
("nullish").
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT, MAX_CLAUSES, MAX_SORTS, MAX_BUCKETS, MAX_STATS = 10_000, 100, 20, 2_000, 100

_TEXT = {"=", "!=", "contains", "starts_with", "ends_with", "matches_regex", "not_matches_regex", "is_null", "is_not_null"}
_ORDER = {"=", "!=", "<", "<=", ">", ">=", "is_null", "is_not_null"}
OPS: dict[str, set[str]] = {
    "text": _TEXT,
    "enum": _TEXT,
    "number": _ORDER,
    "datetime": _ORDER,
    "bool": {"=", "!=", "is_null", "is_not_null"},
    "textarray": {"includes", "is_null", "is_not_null"},
}
AGGREGATES: dict[str, set[str]] = {
    "text": {"count", "count_distinct"},
    "enum": {"count", "count_distinct"},
    "number": {"count", "count_distinct", "sum", "avg", "min", "max"},
    "datetime": {"count", "count_distinct", "min", "max"},
    "bool": {"count", "count_distinct"},
    "textarray": {"count"},
}


class QueryError(ValueError):
    """A query that doesn't fit the dataset's fields."""


@dataclass(frozen=True)
class FieldSpec:
    """A field of a dataset: its kind and what may be done with it. ``json_array`` says that a text column holds a JSON list."""

    name: str
    kind: str
    filterable: bool = True
    sortable: bool = True
    case_sensitive: bool = False
    json_array: bool = False


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: object = None
    negated: bool = False


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    nulls_first: bool = False
    pattern: str | None = None


@dataclass(frozen=True)
class Metric:
    """An aggregate over its own group fields; no ``field`` counts rows."""

    name: str
    op: str = "count"
    field: str | None = None
    group_by: tuple[str, ...] = ()
    limit: int = MAX_BUCKETS


@dataclass(frozen=True)
class Query:
    """Terms are joined by AND, the clauses inside a term by OR."""

    terms: tuple[tuple[Clause, ...], ...] = ()
    sorts: tuple[Sort, ...] = ()
    limit: int = 100
    offset: int = 0
    fields: tuple[str, ...] = field(default=())


Fields = dict[str, FieldSpec]


def fields_of(*specs: FieldSpec) -> Fields:
    return {s.name: s for s in specs}


def _known(fields: Fields, name: str) -> FieldSpec:
    if name not in fields:
        raise QueryError(f"unknown field {name}")
    return fields[name]


def validate(query: Query, fields: Fields) -> None:
    """Reject what the fields don't allow: unknown or closed fields, foreign ops, limits, bad literals."""
    if not 0 <= query.limit <= MAX_LIMIT or query.offset < 0:
        raise QueryError("limit or offset out of range")
    if sum(map(len, query.terms)) > MAX_CLAUSES or len(query.sorts) > MAX_SORTS:
        raise QueryError("too many clauses or sorts")
    for clause in (c for term in query.terms for c in term):
        spec = _known(fields, clause.field)
        if not spec.filterable:
            raise QueryError(f"{clause.field} can't be filtered")
        if clause.op not in OPS[spec.kind]:
            raise QueryError(f"{clause.op} doesn't apply to {spec.kind}")
        if not _pending(clause, spec):
            _literal(spec, clause)
    for s in query.sorts:
        if not _known(fields, s.field).sortable:
            raise QueryError(f"{s.field} can't be sorted")
    for name in query.fields:
        _known(fields, name)


def _pending(clause: Clause, spec: FieldSpec) -> bool:
    """A blank value on a typed or pattern op is a filter still being typed: it holds for all rows."""
    blank = clause.value is None or (isinstance(clause.value, str) and not clause.value.strip())
    typed = spec.kind in ("number", "datetime", "bool") or clause.op not in ("=", "!=")
    return blank and typed and clause.op not in ("is_null", "is_not_null")


def _literal(spec: FieldSpec, clause: Clause) -> object:
    value = clause.value
    if clause.op in ("is_null", "is_not_null"):
        return None
    try:
        if spec.kind == "number":
            return float(value)
        if spec.kind == "datetime":
            return value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        if spec.kind == "bool":
            return value if isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()]
    except (KeyError, ValueError) as e:
        raise QueryError(f"bad {spec.kind}: {value!r}") from e
    return str(value) if value is not None else ""


def array_of(spec: FieldSpec) -> Column:
    """The field's text array; malformed JSON is null."""
    return F.from_json(F.col(spec.name), "array<string>") if spec.json_array else F.col(spec.name)


def nullish(spec: FieldSpec) -> Column:
    """Whether the field is null, an empty text or an empty array."""
    c = F.col(spec.name)
    if spec.json_array:
        return c.isNull() | (c == "") | F.coalesce(F.size(array_of(spec)) == 0, F.lit(False))
    if spec.kind == "textarray":
        return c.isNull() | (F.size(c) == 0)
    if spec.kind in ("text", "enum"):
        return c.isNull() | (c == "")
    return c.isNull()


def present(spec: FieldSpec) -> Column:
    """The field's value, null where nullish."""
    return F.when(~nullish(spec), F.col(spec.name))


def _base(clause: Clause, spec: FieldSpec) -> Column:
    c, op, value = F.col(spec.name), clause.op, _literal(spec, clause)
    if op == "is_null":
        return nullish(spec)
    if op == "is_not_null":
        return ~nullish(spec)
    if op == "includes":
        low = (lambda x: x) if spec.case_sensitive else F.lower
        want = value if spec.case_sensitive else value.lower()
        return F.coalesce(F.exists(array_of(spec), lambda x: low(x) == F.lit(want)), F.lit(False))
    if op in ("matches_regex", "not_matches_regex"):
        try:
            re.compile(value)
        except re.error:
            return F.lit(False)
        hit = c.rlike(value)
        return F.coalesce(hit if op == "matches_regex" else ~hit, F.lit(False))
    if op in ("contains", "starts_with", "ends_with"):
        text = F.lower(F.coalesce(c, F.lit("")))
        want = F.lit(value.lower())
        return {"contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith}[op](want)
    if spec.kind == "datetime":
        value = F.lit(value).cast("timestamp")
    else:
        value = F.lit(value)
    if op == "!=":
        return ~c.eqNullSafe(value)
    compared = {"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
    return F.coalesce(compared, F.lit(False))


def clause_column(clause: Clause, fields: Fields) -> Column:
    """A clause as a predicate; a negated one holds where the field isn't nullish and the clause doesn't hold."""
    spec = _known(fields, clause.field)
    if _pending(clause, spec):
        return F.lit(True)
    hit = _base(clause, spec)
    return ~nullish(spec) & ~hit if clause.negated else hit


def where(df: DataFrame, terms: Sequence[Sequence[Clause]], fields: Fields) -> DataFrame:
    """Rows for which every term has a clause that holds."""
    for term in terms:
        either = None
        for clause in term:
            c = clause_column(clause, fields)
            either = c if either is None else either | c
        if either is not None:
            df = df.where(either)
    return df


def bucket_filter(df: DataFrame, ts: str, unit: str, value: str) -> DataFrame:
    """Rows whose calendar ``unit`` (day, week, month) is ``value``, with a plain range on ``ts`` a day wider so that scans prune."""
    start = datetime.fromisoformat(value + "-01" if unit == "month" and len(value) == 7 else value)
    end = start + timedelta(days={"day": 1, "week": 7, "month": 31}[unit])
    span = (F.col(ts) >= F.lit(start - timedelta(days=1))) & (F.col(ts) < F.lit(end + timedelta(days=1)))
    return df.where(span & (F.date_trunc(unit, F.col(ts)) == F.lit(start).cast("timestamp")))


def order(df: DataFrame, sorts: Sequence[Sort], tie: str) -> list[Column]:
    """Sort columns; nulls (and texts a pattern doesn't match) come last unless asked otherwise, ties break by ``tie``."""
    out = []
    for s in sorts:
        c = F.col(s.field)
        if s.pattern:
            found = F.regexp_extract(c, s.pattern, 1)
            c = F.when(found != "", found)
        elif df.schema[s.field].dataType.simpleString() == "string":
            c = F.when(c != "", c)
        out.append({(False, False): c.asc_nulls_last, (True, False): c.desc_nulls_last, (False, True): c.asc_nulls_first, (True, True): c.desc_nulls_first}[s.descending, s.nulls_first]())
    return [*out, F.col(tie).asc()]


def run(df: DataFrame, query: Query, fields: Fields, tie: str = "id") -> tuple[DataFrame, DataFrame]:
    """(page, total): one page of the filtered and sorted rows, and a one-row frame with the number before paging."""
    validate(query, fields)
    kept = where(df, query.terms, fields)
    page = kept.orderBy(*order(kept, query.sorts, tie)).offset(query.offset).limit(query.limit)
    return (page.select(*query.fields) if query.fields else page), kept.agg(F.count(F.lit(1)).alias("total"))


def _measure(m: Metric, fields: Fields) -> Column:
    if m.field is None:
        if m.op != "count":
            raise QueryError(f"{m.op} needs a field")
        return F.count(F.lit(1))
    spec = _known(fields, m.field)
    if m.op not in AGGREGATES[spec.kind]:
        raise QueryError(f"{m.op} doesn't apply to {spec.kind}")
    value = present(spec)
    return {"count": F.count, "count_distinct": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[m.op](value)


def aggregate(df: DataFrame, metric: Metric, fields: Fields) -> DataFrame:
    """One metric: its group fields and ``value``, largest value first, then by keys; ``limit`` buckets at most.

    Nullish keys are one null group. Without group fields there is always one row.
    """
    keys = [present(_known(fields, g)).alias(g) for g in metric.group_by]
    out = df.groupBy(*keys).agg(_measure(metric, fields).alias("value"))
    if not keys:
        return out
    return out.orderBy(F.col("value").desc_nulls_last(), *[F.col(g).asc_nulls_last() for g in metric.group_by]).limit(min(metric.limit, MAX_BUCKETS))


def aggregate_many(df: DataFrame, metrics: Sequence[Metric], fields: Fields) -> DataFrame:
    """Several metrics over one filtered set in one scan: (metric, keys map, value as double).

    All group-bys are one GROUPING SETS aggregation; each row belongs to the metric whose fields make its set.
    """
    names = sorted({g for m in metrics for g in m.group_by})
    sets = {tuple(sorted(m.group_by)) for m in metrics}
    inputs = [present(_known(fields, g)).cast("string").alias(g) for g in names]
    values = {m.name: _measure(m, fields).cast("double").alias(f"m_{i}") for i, m in enumerate(metrics)}
    if not names:
        grouped = df.agg(*values.values()).withColumn("g_id", F.lit(0).cast("long"))
    else:
        keyed = df.withColumns({f"k_{g}": c for g, c in zip(names, inputs, strict=True)})
        cols = [f"k_{g}" for g in names]
        grouped = keyed.groupingSets([[F.col(f"k_{g}") for g in s] for s in sets], *[F.col(c) for c in cols]).agg(F.grouping_id().alias("g_id"), *values.values())
    out = None
    for i, m in enumerate(metrics):
        own = set(m.group_by)
        gid = sum(1 << (len(names) - 1 - k) for k, g in enumerate(names) if g not in own)
        pairs = [x for g in sorted(own) for x in (F.lit(g), F.col(f"k_{g}"))]
        keys = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        part = grouped.where(F.col("g_id") == gid).select(F.lit(m.name).alias("metric"), keys.alias("keys"), F.col(f"m_{i}").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def timeline_order(df: DataFrame, bucket: str, *rest: str) -> DataFrame:
    """Buckets of a time-keyed metric, newest first."""
    return df.orderBy(F.col(bucket).desc_nulls_last(), *[F.col(r).asc_nulls_last() for r in rest])


def distinct_values(df: DataFrame, name: str, fields: Fields, search: str = "", limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(values, flags): sorted distinct values that contain ``search``, and one row of has_more and has_null.

    Arrays contribute their elements. ``limit`` is held to 1..200.
    """
    limit = max(1, min(limit, 200))
    spec = _known(fields, name)
    nulls = df.agg(F.coalesce(F.max(nullish(spec)), F.lit(False)).alias("has_null"))
    values = df.select(F.explode(array_of(spec)).alias("value")) if spec.kind == "textarray" else df.select(present(spec).alias("value"))
    values = values.where(F.col("value").isNotNull())
    if search:
        values = values.where(F.lower(F.col("value").cast("string")).contains(search.lower()))
    values = values.distinct()
    n = values.agg((F.count(F.lit(1)) > limit).alias("has_more"))  # counted where the values are, one number per task
    return values.orderBy("value").limit(limit), n.crossJoin(F.broadcast(nulls))  # one row each


def field_stats(df: DataFrame, names: Sequence[str], fields: Fields, approximate: bool = False) -> DataFrame:
    """(field, n_distinct, min, max) of up to 100 fields in one scan; min and max as text, for ordered kinds only."""
    if len(names) > MAX_STATS:
        raise QueryError("too many fields")
    aggs, cells = [], []
    for i, name in enumerate(names):
        spec = _known(fields, name)
        value = F.array_join(F.array_sort(array_of(spec)), "\x1f") if spec.kind == "textarray" else present(spec)
        value = F.when(~nullish(spec), value)
        aggs.append((F.approx_count_distinct(value) if approximate else F.countDistinct(value)).alias(f"d{i}"))
        ordered = spec.kind in ("number", "datetime")
        aggs += [(F.min(value) if ordered else F.lit(None)).cast("string").alias(f"a{i}"), (F.max(value) if ordered else F.lit(None)).cast("string").alias(f"z{i}")]
        cells.append(F.struct(F.lit(name).alias("field"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def drill(df: DataFrame, rollup_row: dict[str, object]) -> DataFrame:
    """The rows behind one row of a rollup: equality on every key, null equal to null."""
    for name, value in rollup_row.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df
