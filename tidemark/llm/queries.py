"""Queries of the training-data operators over the tables of a data folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import floor_day
from tidemark.llm import leaks, membership, packing, percentiles, splitting
from tidemark.sources.remote_write import exploded_readings, exploded_series


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- distinct counts

ID_GROUPS = ["day", "tenant", "route", "zone"]


def identifier_rows(spark: SparkSession, folder: str) -> DataFrame:
    """kind, id, day, tenant, route, zone: each identifier label of a series, with the days of its samples."""
    series = exploded_series(table(spark, folder, "remote_writes"), ["tenant", "route", "zone", "client", "trace"])
    ids = series.select(
        "tenant",
        "route",
        "zone",
        F.array_distinct(F.transform("samples", lambda s: floor_day(s["timestamp"]))).alias("days"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in ("client", "trace")])),
    ).where("id is not null")
    return ids.select("kind", "id", F.explode("days").alias("day"), "tenant", "route", "zone").where("day is not null")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return membership.distinct_counts(identifier_rows(spark, folder), "kind", "id", ID_GROUPS).withColumn("day", F.date_from_unix_date("day"))


P2_COUNTS_SQL = """
with series as (select unnest(timeseries) t from remote_writes),
flat as (select unnest(t.samples)."timestamp" ts, [l.value for l in t.labels if l.name = 'tenant'][1] tenant, [l.value for l in t.labels if l.name = 'route'][1] route,
  [l.value for l in t.labels if l.name = 'zone'][1] zone, [l.value for l in t.labels if l.name = 'client'][1] client, [l.value for l in t.labels if l.name = 'trace'][1] trace from series),
ids as (select 'client' kind, client id, cast(epoch_ms(ts) as date) as day, tenant, route, zone from flat where client is not null
  union all select 'trace', trace, cast(epoch_ms(ts) as date), tenant, route, zone from flat where trace is not null)
select kind, concat_ws('+', case when grouping(day) = 0 then 'day' end, case when grouping(tenant) = 0 then 'tenant' end,
    case when grouping(route) = 0 then 'route' end, case when grouping(zone) = 0 then 'zone' end) as "by",
  day, tenant, route, zone, count(distinct id) n_ids, cast(0 as bigint) max_error
from ids group by kind, cube (day, tenant, route, zone)
"""


# --- percentiles

SAMPLE_GROUPINGS = [["metric"], ["instance"], ["zone"]]
WRITE_GROUPINGS = [["__name__"], ["tenant"], ["route"], ["__name__", "tenant", "route"]]


def _sources(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, list]]:
    return [
        ("samples", table(spark, folder, "samples"), SAMPLE_GROUPINGS),
        ("remote_writes", exploded_readings(table(spark, folder, "remote_writes"), ["__name__", "tenant", "route"]), WRITE_GROUPINGS),
    ]


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the whole time, from the sketches of the separate days."""
    out = [
        percentiles.percentiles(percentiles.combine(percentiles.daily_sketches(df, g, "ts_ms", "value"))).select(F.lit(name).alias("of"), "*")
        for name, df, g in _sources(spark, folder)
    ]
    return out[0].unionByName(out[1]).withColumn("key", F.to_json("keys", {"ignoreNullFields": "false"})).drop("keys")


def p5_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    """For each grouping its groups and readings, and whether the percentiles keep the stated rank error.

    One percentile keeps it with a probability of 99 %, so of many 1 % may miss it, give or take three standard errors.
    """
    found = p5_percentiles(spark, folder).select("of", "grouping", "key", "rank_error", *[f"p{q * 100:g}" for q in percentiles.QUANTILES])
    out = []
    for name, df, groupings in _sources(spark, folder):
        rows = df.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))).where("ts_ms is not null")
        each = F.array(*[F.struct(F.lit("+".join(g)).alias("grouping"), F.to_json(F.array(*[F.col(c) for c in g]), {"ignoreNullFields": "false"}).alias("key")) for g in groupings])
        out.append(rows.select(F.lit(name).alias("of"), "value", F.inline(each)))
    rows = out[0].unionByName(out[1]).join(found, ["of", "grouping", "key"])
    counts = rows.groupBy("of", "grouping", "key").agg(
        F.count("*").alias("n"),
        F.first("rank_error").alias("e"),
        *[F.count_if(F.col("value") < F.col(f"p{q * 100:g}")).alias(f"lt{q * 100:g}") for q in percentiles.QUANTILES],
        *[F.count_if(F.col("value") <= F.col(f"p{q * 100:g}")).alias(f"le{q * 100:g}") for q in percentiles.QUANTILES],
    )
    missed = F.lit(0)
    for q in percentiles.QUANTILES:
        slack = F.col("e") * F.col("n") + 1
        within = (F.col(f"lt{q * 100:g}") <= F.lit(q) * F.col("n") + slack) & (F.col(f"le{q * 100:g}") >= F.lit(q) * F.col("n") - slack)
        missed = missed + F.when(within, 0).otherwise(1)
    total = F.count("*") * len(percentiles.QUANTILES)
    return counts.groupBy("of", "grouping").agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n"), (F.sum(missed) <= F.ceil(0.01 * total + 3 * F.sqrt(0.0099 * total))).alias("within_bound")
    )


def _grouped(of: str, source: str, cols: list[str]) -> str:
    name, key = "+".join(cols), ", ".join(cols)
    return f"""select '{of}' as "of", '{name}' as "grouping", count(*) n_groups, cast(sum(n) as bigint) n, true within_bound from (select count(*) n from {source} where isfinite(value) group by {key})"""


P5_WITHIN_BOUND_SQL = """
with series as (select unnest(timeseries) t from remote_writes),
flat as (select unnest(t.samples) s, [l.value for l in t.labels if l.name = '__name__'][1] __name__, [l.value for l in t.labels if l.name = 'tenant'][1] tenant,
  [l.value for l in t.labels if l.name = 'route'][1] route from series),
writes as (select __name__, tenant, route, s.value as value from flat)
""" + " union all ".join([*[_grouped("samples", "samples", g) for g in SAMPLE_GROUPINGS], *[_grouped("remote_writes", "writes", g) for g in WRITE_GROUPINGS]])


# --- containers


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents")).withColumnRenamed("doc", "doc_id")


def p7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document as packed: each is used once, and no container is overfull."""
    packed = p7_containers(spark, folder)
    load = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.max("n").alias("most"))
    return packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces")).withColumn("fits", load.scalar() <= 6000)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each source as packed, and whether each whole window is at the sources' shares of all tokens.

    The total variation of a window from these shares must be at most 0.05.
    """
    packed = packing.pack_documents(table(spark, folder, "documents"))
    sums = packed.groupBy(F.shiftright("container", 32).alias("shard"), "window", "source").agg(F.sum("n_tokens").alias("n"), F.max("container").alias("last"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n_tokens"))
    shares = by_source.select(F.col("source").alias("s"), (F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))).alias("share"))
    parts = sums.join(shares, F.col("source").eqNullSafe(F.col("s"))).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("shard", "window")))
    # Sources without a token in the window are off by their share.
    off = (F.sum(F.abs(F.col("p") - F.col("share"))) + 1 - F.sum("share")) / 2
    end = (F.shiftleft(F.col("shard"), 32) + (F.col("window") + 1) * packing.WINDOW - 1).cast("bigint")
    windows = parts.groupBy("shard", "window").agg(off.alias("off"), F.max("last").alias("last")).where(end == F.col("last"))
    return by_source.withColumn("even", windows.agg(F.coalesce(F.max("off"), F.lit(0.0)).alias("off")).scalar() <= 0.05)


P7_MIXTURE_SQL = "select source, cast(sum(strlen(text)) as bigint) n_tokens, true even from documents where strlen(text) > 0 group by source"

P7_TOKENS_SQL = """
select doc_id, cast(strlen(text) as bigint) n_tokens, cast((strlen(text) + 5999) // 6000 as bigint) n_pieces, true fits from documents where strlen(text) > 0
"""


# --- leaks


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items whose template they share, with the most consecutive words printed."""
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), item_lang="lang")
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_matches(spark, folder).where("leaked").select("doc_id", "item_id")


# --- splitting


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_documents(table(spark, folder, "documents")).withColumnRenamed("doc", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pieces(spark, folder).where("piece = 0 and n_pieces > 1").select("doc_id")


def p9_holds(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document that is cut, and whether its pieces keep what is promised.

    No piece is over 6,000 tokens, each begins 200 to 203 tokens before the end of the one before it, they run from the first
    token to the last, and their texts have as many bytes as tokens.
    """
    p = p9_pieces(spark, folder)
    by = Window.partitionBy("doc_id").orderBy("piece")
    shared = F.lag("end_token").over(by) - F.col("start_token")
    each = (
        (F.col("end_token") - F.col("start_token") <= 6000)
        & F.coalesce(shared.between(200, 203), F.col("start_token") == 0)
        & (F.octet_length("text") == F.col("end_token") - F.col("start_token"))
    )
    rows = p.select("doc_id", "end_token", each.alias("each"), ((F.col("piece") == 0) == (F.col("start_token") == 0)).alias("begins"))
    return rows.groupBy("doc_id").agg(F.max("end_token").alias("n_tokens"), F.every(F.col("each") & F.col("begins")).alias("holds"))


P9_HOLDS_SQL = "select doc_id, cast(strlen(text) as bigint) n_tokens, true holds from documents where strlen(text) > 6000"
P9_FOUND_SQL = "select doc_id from documents where strlen(text) > 6000"


QUERIES = {
    "p2_counts": p2_counts,
    "p5_percentiles": p5_percentiles,
    "p5_within_bound": p5_within_bound,
    "p7_containers": p7_containers,
    "p7_mixture": p7_mixture,
    "p7_tokens": p7_tokens,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p9_found": p9_found,
    "p9_holds": p9_holds,
    "p9_pieces": p9_pieces,
}
SQL = {
    "p2_counts": P2_COUNTS_SQL,
    "p5_within_bound": P5_WITHIN_BOUND_SQL,
    "p7_mixture": P7_MIXTURE_SQL,
    "p7_tokens": P7_TOKENS_SQL,
    "p9_found": P9_FOUND_SQL,
    "p9_holds": P9_HOLDS_SQL,
}
