"""Best matches, one-to-one matches, overlapping intervals, evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T


def best_match(papers: DataFrame, videos: DataFrame, least: float, bonus: Column | None = None) -> DataFrame:
    """For each ``paper_id`` the video of the most similar title (token Jaccard), gated on the raw
    similarity; ``bonus`` only ranks. ``papers`` has ``paper_id, title``; ``videos`` has ``video_id,
    video_title``. Ties go to the least ``video_id``. A paper without match has nulls.

    Two titles as similar as ``least`` share a token among the first ``n - ceil(least * n) + 1`` of
    each when tokens stand from rare to frequent, so only those prefixes are joined and a frequent
    token joins nothing but titles made of frequent ones. Equal titles are compared once.
    """
    own = papers.select("paper_id", F.array_join(F.array_sort(T.title_tokens(F.col("title"))), " ").alias("p"))
    other = videos.select("video_id", F.array_join(F.array_sort(T.title_tokens(F.col("video_title"))), " ").alias("v"), (F.lit(0.0) if bonus is None else bonus.cast("double")).alias("bonus"))
    p, v = own.where("p <> ''").select(F.col("p").alias("t")).distinct(), other.where("v <> ''").select(F.col("v").alias("t")).distinct()
    both = p.withColumn("side", F.lit("p")).unionByName(v.withColumn("side", F.lit("v"))).withColumn("n", F.size(F.split("t", " ")))
    rows = both.select("t", "side", "n", F.explode(F.split("t", " ")).alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df"))
    ranked = rows.join(counts, "token").groupBy("t", "side", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    prefix = ranked.select("t", "side", "n", F.explode(F.slice("ts", F.lit(1), F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1)).alias("x")).select("t", "side", "n", "x.token")
    a, b = prefix.where("side = 'p'").select(F.col("t").alias("p"), F.col("n").alias("np"), "token"), prefix.where("side = 'v'").select(F.col("t").alias("v"), F.col("n").alias("nv"), "token")
    met = a.join(b, "token").where((F.col("np") >= least * F.col("nv") - 1e-9) & (F.col("nv") >= least * F.col("np") - 1e-9)).select("p", "v", "np", "nv").distinct()
    shared = met.withColumn("both", F.size(F.array_intersect(F.split("p", " "), F.split("v", " "))))
    similar = shared.withColumn("similarity", F.col("both") / (F.col("np") + F.col("nv") - F.col("both"))).where(F.col("similarity") >= least).select("p", "v", "similarity", "both")
    # The best video of a title: of each spelling first the one of greatest bonus, then of all spellings.
    top = other.groupBy("v").agg(F.min(F.struct(-F.col("bonus"), "video_id")).alias("k")).select("v", (-F.col("k.col1")).alias("bonus"), F.col("k.video_id").alias("video_id"))
    best = similar.join(top, "v").groupBy("p").agg(F.min_by(F.struct("video_id", "similarity", "both"), F.struct(-(F.col("similarity") + F.col("bonus")), F.col("video_id"))).alias("m"))
    return own.join(best, "p", "left").groupBy("paper_id").agg(F.min_by("m", F.struct(-F.col("m.similarity"), F.col("m.video_id"))).alias("m")).select("paper_id", "m.video_id", "m.similarity", F.col("m.both").cast("bigint").alias("shared_tokens"))


def greedy_pairs(scored: DataFrame, case: str = "case_id") -> DataFrame:
    """One-to-one matches within each case, best score first, ties by ``i`` then ``j``. ``scored``
    has ``case_id, i, j, score``; a case is one evaluation task and is matched in one task."""
    kind = scored.select(case, "i", "j", "score").schema

    def run(f: pd.DataFrame) -> pd.DataFrame:
        used_i, used_j, keep = set(), set(), []
        f = f.sort_values(["score", "i", "j"], ascending=[False, True, True], kind="stable")
        for k, (i, j) in enumerate(zip(f.i, f.j)):
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                keep.append(k)
        return f.iloc[keep]

    return scored.select(case, "i", "j", "score").groupBy(case).applyInPandas(run, kind)


def interval_titles(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """First segment with text that overlaps each chapter (``video_id, start_sec, end_sec``).
    Segments (``video_id, seg_start, seg_end, text``) are joined on the video and the bins of the
    chapter's length that they touch, so a long video is not compared with itself throughout."""
    width = 300
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    c = chapters.withColumn("bin", bins(F.col("start_sec"), F.col("end_sec")))
    s = segments.where(F.length(F.trim("text")) > 0).withColumn("bin", bins(F.col("seg_start"), F.col("seg_end")))
    met = c.join(s, ["video_id", "bin"]).where("seg_end >= start_sec and seg_start <= end_sec")
    best = met.groupBy("video_id", "start_sec").agg(F.min_by("text", F.struct("seg_start", "text")).alias("first_text"))
    return chapters.join(best, ["video_id", "start_sec"], "left")


def expert_matches(experts: DataFrame, topic: str, least: float = 0.15) -> DataFrame:
    """Experts whose domains share at least ``least`` of the topic's tokens, high priority first,
    then by overlap, then in the library's order (``place``)."""
    tokens = T.title_tokens(F.lit(topic))
    overlap = F.size(F.array_intersect(tokens, T.title_tokens(F.array_join("domains", " ")))) / F.size(tokens)
    return experts.withColumn("overlap", overlap).where(F.col("overlap") >= least).orderBy((F.col("priority") == "high").desc(), F.col("overlap").desc(), "place")


def evaluate(matched: DataFrame, said: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case weighted recall, precision and F1 to 4 places: ``matched`` (``case_id, weight``),
    ``said`` (``case_id``, one row a claim), ``gold`` (``case_id, weight``)."""
    m = matched.groupBy("case_id").agg(F.sum("weight").alias("hit"))
    s = said.groupBy("case_id").agg(F.count("*").alias("claims"))
    g = gold.groupBy("case_id").agg(F.sum("weight").alias("total"), F.count("*").alias("gold"))
    j = g.join(s, "case_id", "full_outer").join(m, "case_id", "left").na.fill(0)
    r = F.when(F.col("total") > 0, F.col("hit") / F.col("total")).otherwise(0.0)
    p = F.when(F.col("claims") > 0, F.col("hit") / F.col("claims")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return j.select("case_id", "claims", "gold", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))
