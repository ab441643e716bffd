"""Search hits: plans of requests, relevance, first-wins deduplication, funnel counters, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.session import written

# Weights of the repository score.
W_STARS, W_RECENCY, W_DESC, W_FORKS, W_TOPIC = 0.25, 0.20, 0.10, 0.10, 0.35


def relevance(query: Column, *fields: Column) -> Column:
    """Share of the query's tokens found in the fields; 1 for an empty query, 0 for an empty hit."""
    q, h = T.topic_tokens(query), T.topic_tokens(F.concat_ws("\n", *(F.coalesce(f, F.lit("")) for f in fields)))
    return F.when(F.size(q) == 0, F.lit(1.0)).when(F.size(h) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, h)) / F.size(q))


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order. A partial minimum before the shuffle, so a hot
    key sends one row per task."""
    cols = [c for c in rows.columns if c not in key]
    rank = F.struct(*order)
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*cols), rank).alias("r"))
    return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in cols)).select(*rows.columns)


def request_plan(queries: DataFrame, engines: DataFrame, sorts: list[str], pages: int, budget: int) -> DataFrame:
    """Requests in order of query, then sort and page, then engine, cut at ``budget``. ``queries``
    (``query_no``) and ``engines`` (``engine_no``) are stated small sets. The place of a request is
    computed from its parts, so nothing is sorted."""
    combos = queries.sparkSession.createDataFrame([(i * pages + p, s, p) for i, s in enumerate(sorts) for p in range(pages)], "combo int, sort string, page int")
    n_e = engines.agg(F.count("*").alias("engines"))
    n_c = len(sorts) * pages
    queries = queries.where(F.col("query_no") * n_c < budget)  # no later query has a place within the budget
    rows = queries.join(F.broadcast(combos), how="cross").join(F.broadcast(engines), how="cross").join(F.broadcast(n_e), how="cross")
    place = (F.col("combo") * F.lit(1) * F.col("engines") + F.col("engine_no")) + F.col("query_no") * n_c * F.col("engines")
    return rows.withColumn("place", place.cast("bigint")).where(F.col("place") < budget).drop("engines", "combo")


def request_budget(max_requests: int, engines: int, queries: int, wanted: int, per_request: int, concurrency: int) -> int:
    """Requests that may be made: at least one per engine and query, never more than planned."""
    return min(max_requests, max(engines * queries, -(-wanted // per_request) + concurrency - 1))


def funnel(calls: DataFrame, hits: DataFrame, threshold: float, capacity: int | None = None) -> DataFrame:
    """Counters per engine: attempted, hits, failed, filtered (irrelevant or over capacity),
    deduplicated, retained. ``hits`` has ``engine, url_key, query, title, snippet, url, order`` (orders
    differ); relevance comes first, then deduplication over all engines, then the first ``capacity`` in order."""
    keep = relevance(F.col("query"), F.col("title"), F.col("snippet"), F.col("url")) >= threshold
    scored = written(hits.select("engine", "url_key", "order", keep.alias("keep")), "scored-hits")  # texts are read once
    first = scored.where("keep").groupBy("url_key").agg(F.min("order").alias("first"))
    marked = scored.join(first, "url_key", "left").withColumn("unique", F.col("keep") & (F.col("order") == F.col("first")))
    within = F.lit(True)
    if capacity is not None:
        last = marked.where("unique").select("order").orderBy("order").limit(capacity).agg(F.max("order").alias("last"))
        marked, within = marked.join(F.broadcast(last)), F.col("order") <= F.col("last")  # one row is broadcast
    counted = marked.groupBy("engine").agg(
        F.count("*").alias("hits"),
        F.count_if(~F.col("keep") | (F.col("unique") & ~within)).alias("filtered"),
        F.count_if(F.col("keep") & ~F.col("unique")).alias("deduplicated"),
        F.count_if(F.col("unique") & within).alias("retained"),
    )
    tried = calls.groupBy("engine").agg(F.count("*").alias("attempted"), F.count_if("failed").alias("failed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return tried.join(counted, "engine", "full_outer").select("engine", *(zero(c) for c in ("attempted", "hits", "failed", "filtered", "deduplicated", "retained")))


def merged_audits(*audits: DataFrame) -> DataFrame:
    """Counters of several runs summed by engine."""
    out = audits[0]
    for a in audits[1:]:
        out = out.unionByName(a)
    return out.groupBy("engine").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in out.columns if c != "engine"))


def top_per_key(rows: DataFrame, key: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps ``n`` rows per key and task before the shuffle
    (window group limit)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)


def take_until(rows: DataFrame, key: list[str], order: str, matched: Column, k: int) -> DataFrame:
    """Rows of each key in order (``order`` differs within a key), up to and with the ``k``-th that
    matches. Only ``k`` matching rows of a key are ranked; the others are compared with the last of them."""
    ranked = top_per_key(rows.where(matched).select(*key, order), key, [F.col(order)], k)
    last = ranked.groupBy(*key).agg(F.max(order).alias("last"), F.count("*").alias("found"))
    j = rows.join(last, key, "left").where((F.coalesce("found", F.lit(0)) < k) | (F.col(order) <= F.col("last")))
    return j.select(*rows.columns)


def repo_score(stars: Column, forks: Column, description: Column, homepage: Column, pushed: Column, as_of: Column, query: Column, words: Column) -> Column:
    """Composite score of a repository: stars, recency, description, forks per star, topic overlap."""
    s = F.coalesce(stars.cast("double"), F.lit(0.0))
    f = F.coalesce(forks.cast("double"), F.lit(0.0))
    by_stars = F.least(F.greatest(F.log1p(s) / F.log1p(F.lit(100_000.0)), F.lit(0.0)), F.lit(1.5))
    recency = F.coalesce(F.exp(-F.greatest((F.unix_micros(as_of) - F.unix_micros(pushed)) / 86_400_000_000.0, F.lit(0.0)) / 180), F.lit(0.0))
    d = F.coalesce(description, F.lit(""))
    desc = F.when(F.length(F.trim(d)) >= 20, 1.0).when(d != "", 0.4).otherwise(0.0)
    desc = F.when(F.coalesce(homepage, F.lit("")) != "", F.least(desc + 0.2, F.lit(1.0))).otherwise(desc)
    ratio = f / s
    fork = F.when(s > 0, F.when(ratio < 0.01, 0.3).when(ratio > 2, 0.2).otherwise(F.least(ratio * 2, F.lit(1.0)))).when(f == 0, 0.5).otherwise(0.3)
    q, t = T.title_tokens(query), T.title_tokens(words)
    topic = F.when((F.size(q) > 0) & (F.size(t) > 0), F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)
    return W_STARS * by_stars + W_RECENCY * recency + W_DESC * desc + W_FORKS * fork + W_TOPIC * topic


def latest_fresh(rows: DataFrame, key: list[str], written_at: str, ttl_days: int, as_of: Column) -> DataFrame:
    """The newest row of each key when it is younger than ``ttl_days`` (0: never expires)."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.col(written_at)).alias("r"))
    out = best.select(*key, "r.*")
    return out if not ttl_days else out.where(F.unix_micros(as_of) - F.unix_micros(F.col(written_at)) < ttl_days * 86_400_000_000)


def budget_prefix(rows: DataFrame, group: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows of each group, in order, up to the first that would exceed the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
