"""Selecting series and samples of one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import to_long
from tidemark.model import Matcher, NoSuchLabel, NoSuchScalar, TableSchema, Unsupported
from tidemark.operators import grid


def matches(m: Matcher, column: Column) -> Column:
    """A predicate on the raw label column; ``=`` and NULL tests reach the file scan.

    ``=`` and ``=~`` never take a missing label; ``!=`` and ``!~`` are their exact complements.
    Patterns must match the whole value.
    """
    if m.value is None:
        if m.op not in ("=", "!="):
            raise Unsupported("a pattern must be a string")
        return column.isNull() if m.op == "=" else column.isNotNull()
    match m.op:
        case "=":
            return column == F.lit(m.value)
        case "!=":
            return ~column.eqNullSafe(F.lit(m.value))
        case "=~" | "!~":
            hit = F.coalesce(column.rlike(rf"\A(?:{m.value})\z"), F.lit(False))
            return hit if m.op == "=~" else ~hit
    raise Unsupported(f"the matcher {m.op}")


@dataclass(frozen=True)
class Table:
    """A table over a DataFrame: which columns are its time, arrival order, labels and scalars.

    ``deduplicated`` tells that the rows have one sample per series and slot already;
    ``retention`` applies the limit of live chunks; ``unique`` tells that no two rows share a ``seq``.
    """

    schema: TableSchema
    rows: DataFrame
    ts: str
    seq: str | None
    retention: bool = False
    deduplicated: bool = False
    unique: bool = True

    def typed(self, scalars: Sequence[str]) -> list[Column]:
        kinds = dict(self.schema.scalars)
        return [(to_long(self.rows[s]) if kinds[s] == "int" and self.rows.schema[s].dataType.simpleString() in ("double", "float") else self.rows[s].cast("bigint" if kinds[s] == "int" else "double")).alias(s) for s in scalars]


def scan(
    table: Table,
    projections: Sequence[str] | None = None,
    matchers: Sequence[Matcher] = (),
    start_ms: int | None = None,
    end_ms: int | None = None,
    whole_chunks: bool = False,
) -> DataFrame:
    """Samples in long form: all labels, the grid columns and the projected scalars.

    The range is half open, in whole slots.  ``whole_chunks`` leaves the cutting to the caller.
    Unknown labels and scalars raise at once.
    """
    s, meta = table.schema, table.schema.meta
    scalars = list(s.scalar_names if projections is None else projections)
    for name in scalars:
        if name not in s.scalar_names:
            raise NoSuchScalar(f"{s.name} has no scalar {name}")
    for m in matchers:
        if m.label not in s.labels:
            raise NoSuchLabel(f"{s.name} has no label {m.label}")
    rows = table.rows
    seq = rows[table.seq].alias("_seq") if table.seq else F.lit(0).alias("_seq")

    def long(source: DataFrame, keep: Sequence[str]) -> DataFrame:
        columns = [source[x].cast("string").alias(x) for x in s.labels if x in keep]
        return grid.placed(source.select(*columns, seq, grid.epoch_ms(source, table.ts).alias("_t"), *table.typed([x for x in scalars if x in keep])), F.col("_t"), meta).drop("_t")

    wanted = F.lit(True)
    for m in matchers:
        wanted = wanted & matches(m, rows[m.label] if rows.schema[m.label].dataType.simpleString() == "string" else rows[m.label].cast("string"))
    lo, hi = grid.slot_bounds(start_ms, end_ms, meta)
    if lo is not None and hi is not None and lo >= hi:
        wanted = wanted & F.lit(False)
    elif not whole_chunks:
        wanted = wanted & grid.time_bounds(rows, table.ts, lo, hi)
    out = long(rows.where(rows[table.ts].isNotNull() & wanted), [*s.labels, *scalars])
    if table.retention:
        out = out.where(F.col("chunk_start") >= grid.live_from(long(rows, []), "_seq", meta).scalar())
    if not table.deduplicated:
        return grid.last_write(out, s.labels, scalars, "_seq", meta, table.unique)
    return out.select(*s.labels, *grid.GRID, *scalars)


def limited(df: DataFrame, labels: Sequence[str], n: int) -> DataFrame:
    """The samples of the first ``n`` series-chunks by chunk start and labels."""
    if n < 0:
        raise Unsupported("a negative limit")
    keys = df.select("chunk_start", *labels).distinct().orderBy("chunk_start", *labels).limit(n)
    same = F.lit(True)
    renamed = keys.select(*[F.col(c).alias(f"_k_{c}") for c in keys.columns])
    for c in keys.columns:
        same = same & df[c].eqNullSafe(renamed[f"_k_{c}"])
    return df.join(renamed, same, "left_semi")
