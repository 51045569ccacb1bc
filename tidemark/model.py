"""Data model: tables of series on a time grid, query expressions and errors."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal


class TidemarkError(Exception):
    """Any error of this package.  After one the engine stays usable."""


class WriteError(TidemarkError):
    pass


class TimestampArchived(WriteError):
    """A sample is older than the oldest live chunk."""


class MissingName(WriteError):
    """A series has no ``__name__``."""


class DuplicateLabel(WriteError):
    """A series names a label twice."""


class SchemaMismatch(WriteError):
    """A write has a label or scalar that the table, frozen at its first write, lacks."""


class InternalError(TidemarkError):
    pass


class ScanError(TidemarkError):
    pass


class NoSuchTable(ScanError):
    pass


class NoSuchLabel(ScanError):
    pass


class NoSuchScalar(ScanError):
    pass


class QueryError(TidemarkError):
    pass


class ParseError(QueryError):
    pass


class NoName(ParseError):
    """A selector names no metric."""


class NoSuchField(QueryError):
    """An aggregation groups by a label that the table lacks."""


class Unsupported(QueryError):
    pass


class ManyToMany(QueryError):
    """Several series of a side that must have one meet the same series of the other."""


@dataclass(frozen=True)
class TableMeta:
    """Grid of a table: slots of ``interval_ms``, ``series_len`` of them a chunk, so many chunks live."""

    series_len: int = 120
    interval_ms: int = 1000
    live_chunks: int = 5

    @property
    def chunk_ms(self) -> int:
        return self.series_len * self.interval_ms


ScalarKind = Literal["int", "float"]


@dataclass(frozen=True)
class TableSchema:
    """Nullable string labels and numeric scalars, in order."""

    name: str
    labels: tuple[str, ...]
    scalars: tuple[tuple[str, ScalarKind], ...]
    meta: TableMeta = TableMeta()

    def __post_init__(self) -> None:
        names = [*self.labels, *(n for n, _ in self.scalars)]
        if len(set(names)) < len(names):
            raise DuplicateLabel(f"{self.name}: a label or scalar is named twice in {names}")

    @property
    def scalar_names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.scalars)


Operator = Literal["=", "!=", "=~", "!~"]


@dataclass(frozen=True)
class Matcher:
    """``label op value``.  ``value`` None with ``=`` or ``!=`` asks for series without, or with, the label."""

    label: str
    op: Operator
    value: str | None


@dataclass(frozen=True)
class Selector:
    """Samples of one table; ``range_ms`` restricts them to the time before ``now``."""

    table: str
    matchers: tuple[Matcher, ...] = ()
    range_ms: int | None = None
    offset_ms: int = 0


@dataclass(frozen=True)
class Call:
    """A range function over the samples of each series."""

    function: str
    arg: Expr
    params: tuple[float, ...] = ()


@dataclass(frozen=True)
class Aggregate:
    """An aggregation across series: ``by`` / ``without`` labels, or over all."""

    function: str
    arg: Expr
    mode: Literal["by", "without", "all"] = "all"
    labels: tuple[str, ...] = ()
    param: float | str | None = None


@dataclass(frozen=True)
class Apply:
    """A function of the values, or of the labels, of each sample of a vector."""

    function: str
    arg: Expr
    params: tuple[float | str, ...] = ()


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Now:
    """The time of evaluation in seconds."""


@dataclass(frozen=True)
class Binary:
    """``left op right``; ``on`` / ``ignoring`` choose the labels that two vectors are matched by.

    ``many`` is the side of which several series may meet one of the other; ``include`` names labels taken over from that one.
    """

    op: str
    left: Expr
    right: Expr
    match: Literal["on", "ignoring", "all"] = "all"
    labels: tuple[str, ...] = ()
    bool_result: bool = False
    many: Literal["left", "right"] | None = None
    include: tuple[str, ...] = ()


Expr = Selector | Call | Aggregate | Apply | Number | Now | Binary

