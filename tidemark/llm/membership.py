"""Exact distinct counts for any combination of groups, from membership patterns.

Each identifier is reduced to the set of groups that hold it.  Identifiers with the same set
are the same pattern, and only how many there are is kept.  The identifiers of any union or
intersection of groups are then those of the patterns that touch them: a sum of pattern totals.

Identifiers are carried as 128 bits of hash, and a pattern is named by two XORs of 64-bit hashes
of its groups, so no set is ever gathered in one place.  Two identifiers or two patterns share a
name with a probability of 2**-128; apart from that the counts are exact: among m of them the
error is 0 with a probability of at least 1 - m**2 / 2**129.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER = ["kind", "id1", "id2"]
PATTERN = ["kind", "name1", "name2"]


#: Rows that a task brings together before it takes out repetitions.
GATHERED = 200_000


def counted_in_task(df: DataFrame, n: str | None = None) -> DataFrame:
    """Fewer repetitions, without a shuffle: one row of those alike among each ``GATHERED`` of a task, how many in ``n``."""

    def grouped(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held[0].schema.names
        t = pa.Table.from_batches(held).group_by(names, use_threads=False).aggregate([([], "count_all")] if n else [])
        yield from t.select([*names, "count_all"]).rename_columns([*names, n]).to_batches() if n else t.to_batches()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= GATHERED:
                yield from grouped(held)
                held, size = [], 0
        if size:
            yield from grouped(held)

    return df.mapInArrow(once, T.StructType([*df.schema, *([T.StructField(n, T.LongType())] if n else [])]))


def memberships(df: DataFrame, kind: str, identifier: str, groups: Sequence[str]) -> DataFrame:
    """Distinct (kind, identifier, groups), placed by identifier: the partial result of a day or any part.

    Repetitions are taken out within each task first, so of a hot identifier each task sends little
    more than the groups it has.  Rows with a NULL identifier are left out, ``""`` is an identifier.
    NULL group values are values of their own and differ from ``""``.
    """
    rows = df.where(df[identifier].isNotNull()).select(
        df[kind].alias("kind"),
        F.xxhash64(F.lit(3), df[identifier]).alias("id1"),
        F.xxhash64(df[identifier], F.lit(5)).alias("id2"),
        *[df[g].alias(g) for g in groups],
    )
    return counted_in_task(rows).repartition(*IDENTIFIER).distinct()


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """Memberships of several parts together.  The parts may overlap."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition(*IDENTIFIER).distinct()


def _group_hash(groups: Sequence[str], seed: int) -> Column:
    # A NULL leaves Spark's hash as it is, so whether a value is there is hashed too.
    cols: list[Column] = [F.lit(seed)]
    for g in groups:
        cols += [F.col(g).isNull(), F.coalesce(F.col(g).cast("string"), F.lit(""))]
    return F.xxhash64(*cols)


def pattern_totals(members: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per pattern and group of the pattern, with ``n``, the identifiers of the pattern.

    Totals of parts that share no identifier are merged by adding ``n``.
    """
    whole = Window.partitionBy(*IDENTIFIER)
    named = members.select(
        "kind",
        *groups,
        F.bit_xor(_group_hash(groups, 1)).over(whole).alias("name1"),
        F.bit_xor(_group_hash(groups, 2)).over(whole).alias("name2"),
    )
    # Each identifier has one row per group of its pattern, so rows of a pattern and group count its identifiers.
    # A pattern that most of them have is counted in each task first: it sends a row per group, not per identifier.
    return counted_in_task(named, "n").repartition(*PATTERN).groupBy(*PATTERN, *groups).agg(F.sum("n").alias("n"))


def count_any(totals: DataFrame, condition: Column) -> DataFrame:
    """Identifiers of each kind in at least one group that meets ``condition``."""
    return totals.where(condition).select(*PATTERN, "n").distinct().groupBy("kind").agg(F.sum("n").alias("n_ids"))


def count_all(totals: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """Identifiers of each kind that have, for every condition, a group that meets it."""
    met = totals.groupBy(*PATTERN, "n").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"m{i}") for i, c in enumerate(conditions)])
    for i in range(len(conditions)):
        met = met.where(F.col(f"m{i}"))
    return met.groupBy("kind").agg(F.sum("n").alias("n_ids"))


def counts_of_combinations(totals: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Identifiers of each kind for every value of every combination of ``groups``.

    ``by`` names the groups of a combination, joined with ``+`` (``""`` is the whole); the columns
    of the others are NULL.  ``max_error`` is the error bound of the count, 0.

    The totals are placed by pattern, so that making each pattern count once for each value
    needs no shuffle; only the sums are shuffled.
    """
    sets = [list(c) for r in range(len(groups) + 1) for c in combinations(groups, r)]
    types = {g: totals.schema[g].dataType for g in groups}
    choice = F.array(
        *[F.struct(F.lit(i).cast("tinyint").alias("_set"), *[(F.col(g) if g in c else F.lit(None).cast(types[g])).alias(g) for g in groups]) for i, c in enumerate(sets)]
    )
    spread = totals.select(*PATTERN, "n", F.inline(choice))
    once = spread.groupBy(*PATTERN, "n", "_set", *groups).agg(F.lit(1).alias("_"))
    names = F.array(*[F.lit("+".join(c)) for c in sets])
    return (
        once.groupBy("kind", "_set", *groups)
        .agg(F.sum("n").alias("n_ids"))
        .select("kind", F.get(names, F.col("_set").cast("int")).alias("by"), *groups, "n_ids", F.lit(0).cast("bigint").alias("max_error"))
    )


def distinct_counts(df: DataFrame, kind: str, identifier: str, groups: Sequence[str]) -> DataFrame:
    """Counts for all combinations of ``groups`` in one go.

    Empty tables give no rows.  Repeated rows change nothing.  Extra columns aren't read.
    """
    return counts_of_combinations(pattern_totals(memberships(df, kind, identifier, groups), groups), groups)
