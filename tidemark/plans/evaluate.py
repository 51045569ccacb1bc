"""Turning a query expression into a DataFrame.

A vector is a DataFrame of labels, maybe ``ts_ms``, and ``value``.  Samples and aggregations of them are
per slot; range functions give one row per series, and what is built on them has no ``ts_ms``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import Aggregate, Apply, Binary, Call, Expr, ManyToMany, NoSuchField, Now, Number, Selector, Unsupported
from tidemark.operators import aggregate as agg
from tidemark.operators.scan import Table, scan

VALUE = "value"


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    labels: list[str]
    timed: bool

    @property
    def keys(self) -> list[str]:
        return (["ts_ms"] if self.timed else []) + self.labels


def selected(e: Selector, table: Table, now_ms: int) -> Vector:
    """The samples of the range before ``now``, or all; an offset shifts both ends back and the times forth."""
    start = None if e.range_ms is None else now_ms - e.range_ms - e.offset_ms
    end = None if e.range_ms is None or not e.offset_ms else now_ms - e.offset_ms
    rows = scan(table, [VALUE], e.matchers, start, end)
    if e.offset_ms:
        rows = rows.withColumn("ts_ms", F.col("ts_ms") + e.offset_ms)
    labels = list(table.schema.labels)
    return Vector(rows.select(*labels, "ts_ms", VALUE), labels, True)


def evaluate(e: Expr, lookup: Callable[[str], Table], now_ms: int) -> Vector | float:
    match e:
        case Number():
            return e.value
        case Now():
            return now_ms / 1000
        case Apply():
            return applied(e, _vector(evaluate(e.arg, lookup, now_ms)))
        case Selector():
            return selected(e, lookup(e.table), now_ms)
        case Call():
            v = _vector(evaluate(e.arg, lookup, now_ms))
            return Vector(agg.over_time(v.df, e.function, v.labels, e.arg.range_ms, e.params), v.labels, False)
        case Aggregate():
            v = _vector(evaluate(e.arg, lookup, now_ms))
            labels = agg.group_labels(v.labels, e.mode, e.labels)
            keys = (["ts_ms"] if v.timed else []) + labels
            df = agg.aggregate(v.df, e.function, keys, VALUE, e.param)
            if e.function in ("topk", "bottomk"):
                return Vector(df, v.labels, v.timed)
            return Vector(df, labels + ([str(e.param)] if e.function == "count_values" else []), v.timed)
        case Binary():
            return binary(e, evaluate(e.left, lookup, now_ms), evaluate(e.right, lookup, now_ms))
    raise Unsupported(f"{e}")


def _vector(v: Vector | float) -> Vector:
    if not isinstance(v, Vector):
        raise Unsupported("a number where a vector is needed")
    return v


_VALUES: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "ceil": F.ceil,
    "floor": F.floor,
    "exp": F.exp,
    "ln": F.log,
    "log2": F.log2,
    "log10": F.log10,
    "sqrt": F.sqrt,
    "sgn": F.signum,
    "deg": F.degrees,
    "rad": F.radians,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
}


def applied(e: Apply, v: Vector) -> Vector:
    """A function of each sample's value, or of its labels.  Logarithms of what has none are NaN or minus infinity."""
    x, nan = F.col(VALUE).cast("double"), F.lit(float("nan"))
    if e.function in ("sort", "sort_desc"):
        return Vector(v.df.orderBy(F.isnan(x), x.desc() if e.function == "sort_desc" else x.asc()), v.labels, v.timed)
    if e.function == "histogram_quantile":
        return histogram_quantile(v, float(e.params[0]))
    if e.function in ("label_replace", "label_join"):
        return relabelled(e, v)
    if e.function in ("ln", "log2", "log10"):
        out = F.when(F.isnan(x) | (x < 0), nan).when(x == 0, F.lit(float("-inf"))).otherwise(_VALUES[e.function](x))
    elif e.function in ("ceil", "floor"):
        # As doubles, so that infinities and numbers beyond the integers stay.
        out = F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(_VALUES[e.function](x).cast("double"))
    elif e.function == "round":
        to = float(e.params[0]) if e.params else 1.0
        out = F.when(F.isnan(x) | (F.abs(x / to) >= 2.0**53), x).otherwise(F.floor(x / to + 0.5).cast("double") * to)
    elif e.function == "clamp":
        low, high = e.params
        out = F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))
        if low > high:
            return Vector(v.df.where(F.lit(False)), v.labels, v.timed)
    elif e.function in ("clamp_min", "clamp_max"):
        bound = F.lit(float(e.params[0]))
        out = F.when(F.isnan(x), x).otherwise(F.greatest(bound, x) if e.function == "clamp_min" else F.least(bound, x))
    else:
        out = _VALUES[e.function](x)
    return Vector(v.df.select(*v.keys, out.alias(VALUE)), v.labels, v.timed)


def relabelled(e: Apply, v: Vector) -> Vector:
    """``label_replace`` (the pattern must match the whole source value) and ``label_join``; a missing label counts as "".

    A label that becomes "" is missing.
    """
    of = lambda name: F.coalesce(F.col(name), F.lit("")) if name in v.labels else F.lit("")
    if e.function == "label_replace":
        target, replacement, source, pattern = e.params
        new = F.regexp_replace(of(source), f"^(?:{pattern})$", str(replacement))
        same = F.col(target) if target in v.labels else F.lit(None).cast("string")
        new = F.when(of(source).rlike(f"^(?:{pattern})$"), F.nullif(new, F.lit(""))).otherwise(same)
    else:
        target, separator, *sources = e.params
        new = F.nullif(F.concat_ws(str(separator), *[of(x) for x in sources]), F.lit(""))
    labels = v.labels if target in v.labels else [*v.labels, str(target)]
    keys = (["ts_ms"] if v.timed else []) + [x for x in v.labels if x != target]
    return Vector(v.df.select(*keys, new.alias(str(target)), VALUE), labels, v.timed)


def histogram_quantile(v: Vector, q: float) -> Vector:
    """The quantile of each histogram, whose cumulative buckets differ in the label ``le``; linear within a bucket.

    Without a bucket up to ``+Inf``, or with no count, it is NaN.
    """
    if "le" not in v.labels:
        raise NoSuchField("no label le")
    labels = [x for x in v.labels if x != "le"]
    keys = (["ts_ms"] if v.timed else []) + labels
    bound = F.when(F.lower("le").isin("+inf", "inf"), float("inf")).otherwise(F.expr("try_cast(le as double)"))
    rows = v.df.withColumn("_le", bound).where("_le is not null")
    # A histogram has few buckets, so a window holds few rows.
    by = Window.partitionBy(*keys).orderBy("_le")
    whole = Window.partitionBy(*keys)
    rows = rows.select(
        *keys,
        "_le",
        F.col(VALUE).alias("_n"),
        F.lag(VALUE, 1, 0.0).over(by).alias("_before"),
        F.lag("_le").over(by).alias("_low"),
        F.max_by(VALUE, "_le").over(whole).alias("_all"),
        F.max("_le").over(whole).alias("_top"),
    )
    first = rows.where(F.col("_n") >= min(max(q, 0.0), 1.0) * F.col("_all")).groupBy(*keys).agg(F.min_by(F.struct("_le", "_n", "_before", "_low", "_all", "_top"), "_le").alias("_b"))
    b = {c: F.col(f"_b.{c}") for c in ("_le", "_n", "_before", "_low", "_all", "_top")}
    low = F.coalesce(b["_low"], F.when(b["_le"] <= 0, b["_le"]).otherwise(0.0))
    inside = low + (b["_le"] - low) * (q * b["_all"] - b["_before"]) / F.nullif(b["_n"] - b["_before"], F.lit(0.0))
    out = F.when((b["_top"] != float("inf")) | (b["_all"] == 0), float("nan")).when(b["_le"] == float("inf"), b["_low"]).otherwise(F.coalesce(inside, low))
    if not 0 <= q <= 1:
        out = F.lit(float("-inf") if q < 0 else float("inf"))
    return Vector(first.select(*keys, out.alias(VALUE)), labels, v.timed)


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    match op:
        case "+":
            return a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "^":
            return F.pow(a, b)
        case "/":  # as for IEEE numbers; Spark raises on a division by zero
            return F.when(b == 0, F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).otherwise(-inf)).otherwise(a / F.when(b != 0, b))
        case "%":
            return F.when(b == 0, nan).otherwise(a % F.when(b != 0, b))
    raise Unsupported(f"the operator {op}")


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _combined(e: Binary, df: DataFrame, a: Column, b: Column, kept: Column, columns: list[str]) -> DataFrame:
    if e.op in _COMPARE:
        true = _COMPARE[e.op](a, b)
        if e.bool_result:
            return df.select(*columns, true.cast("double").alias(VALUE))
        return df.where(true).select(*columns, kept.alias(VALUE))
    return df.select(*columns, _arithmetic(e.op, a, b).alias(VALUE))


def binary(e: Binary, left: Vector | float, right: Vector | float) -> Vector | float:
    """Arithmetic and comparisons on equal labels and times, one to one, or many to one with ``e.many``; ``and``,
    ``or``, ``unless`` by them.

    A side that must have one series for each match, but is not sure to by its labels, is counted when this is
    called; :class:`ManyToMany` tells if it has more.
    """
    if not isinstance(left, Vector) and not isinstance(right, Vector):
        return _numbers(e, left, right)
    if not isinstance(left, Vector) or not isinstance(right, Vector):
        v = left if isinstance(left, Vector) else right
        if e.op in ("and", "or", "unless"):
            raise Unsupported(f"{e.op} with a number")
        a = F.col(VALUE) if v is left else F.lit(float(left))
        b = F.col(VALUE) if v is right else F.lit(float(right))
        return Vector(_combined(e, v.df, a, b, F.col(VALUE), v.keys), v.labels, v.timed)
    if left.timed != right.timed:
        raise Unsupported("a vector with times against one without")
    if e.match == "on":
        by = list(e.labels)
    elif e.match == "ignoring":
        by = [x for x in left.labels if x in right.labels and x not in e.labels]
    else:
        by = left.labels
    for x in by:
        if x not in left.labels or x not in right.labels:
            raise NoSuchField(f"no label {x} on both sides")
    if e.match == "all" and set(left.labels) != set(right.labels):
        raise NoSuchField("the sides have different labels; name those to match with on or ignoring")
    keys = (["ts_ms"] if left.timed else []) + by
    r = right.df.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(VALUE).alias("_r_value"))
    same = F.lit(True)
    for k in keys:
        same = same & left.df[k].eqNullSafe(r[f"_r_{k}"])
    if e.op == "and":
        return Vector(left.df.join(r, same, "left_semi"), left.labels, left.timed)
    if e.op == "unless":
        return Vector(left.df.join(r, same, "left_anti"), left.labels, left.timed)
    if e.op == "or":
        lk = left.df.select(*[F.col(k).alias(f"_l_{k}") for k in keys])
        absent = F.lit(True)
        for k in keys:
            absent = absent & right.df[k].eqNullSafe(lk[f"_l_{k}"])
        rest = right.df.join(lk, absent, "left_anti")
        return Vector(left.df.select(*left.keys, VALUE).unionByName(rest.select(*right.keys, VALUE), allowMissingColumns=True), list(dict.fromkeys(left.labels + right.labels)), left.timed)
    for side, name in ((left, "left"), (right, "right")):
        if e.many != name and not set(side.labels) <= set(by):
            if side.df.groupBy(*keys).count().where("count > 1").limit(1).count():
                raise ManyToMany(f"several series of the {name} side of {e.op} have the same {', '.join(by) or 'empty'} labels")
    many, one = (right, left) if e.many == "right" else (left, right)
    for x in e.include:
        if x not in one.labels:
            raise NoSuchField(f"no label {x} on the one side")
    o = one.df.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(VALUE).alias("_r_value"), *[F.col(x).alias(f"_i_{x}") for x in e.include])
    same = F.lit(True)
    for k in keys:
        same = same & many.df[k].eqNullSafe(o[f"_r_{k}"])
    joined = many.df.join(o, same, "inner")
    a, b = (F.col("_r_value"), F.col(VALUE)) if many is right else (F.col(VALUE), F.col("_r_value"))
    columns = keys if e.match != "all" and e.op not in _COMPARE and not e.many else many.keys
    columns = [c for c in columns if c not in e.include]
    joined = joined.select(*columns, *[F.col(f"_i_{x}").alias(x) for x in e.include], F.col(VALUE), F.col("_r_value"))
    columns = [*columns, *e.include]
    return Vector(_combined(e, joined, a, b, a, columns), [c for c in columns if c != "ts_ms"], left.timed)


def _numbers(e: Binary, a: float, b: float) -> float:
    import operator

    if e.op in _COMPARE:
        if not e.bool_result:
            raise Unsupported("a comparison of numbers without bool")
        return float({"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[e.op](a, b))
    ops = {"+": operator.add, "-": operator.sub, "*": operator.mul, "^": operator.pow, "/": operator.truediv, "%": lambda x, y: x - y * int(x / y)}
    if e.op not in ops:
        raise Unsupported(f"{e.op} of numbers")
    try:
        return float(ops[e.op](a, b))
    except ZeroDivisionError:
        return float("nan") if e.op == "%" or a == 0 or a != a else float("inf") if a > 0 else float("-inf")
