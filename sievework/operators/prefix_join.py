"""Set-overlap self-join with adaptive multi-match prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of verifying a candidate against that of emitting one token match, and the estimated chance
#: that two sets which met once meet once more.
VERIFY_COST, REPEAT = 200, 0.05


def adaptive_prefixes(sets: DataFrame, overlap: int) -> DataFrame:
    """Prefix of each token set, as long as its estimated candidate cost asks for.

    ``sets`` has ``id`` and ``tokens`` (distinct values of any type that can be compared). Tokens
    are ordered from rare to frequent by their counts over all sets. Two sets that share at least
    ``overlap`` tokens share at least ``m`` tokens of their prefixes of length
    ``size - overlap + m``; for each set the ``m`` in 1..overlap is chosen that costs least, where
    a longer prefix meets more tokens but a pair needs ``m`` of them before it is verified.
    Tokens of one set only cannot match and are left out once they have taken their place.

    Returns ``id, token, need``. Sets smaller than ``overlap``, null and empty ones give no rows.
    """
    rows = sets.where(F.size("tokens") >= overlap).select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        rows.join(counts, "token")
        .groupBy("id")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        .withColumn("unique", F.col("n") - F.size("shared"))
    )
    def cost(m: int):
        kept = f"slice(shared, 1, greatest(n - {overlap} + {m} - unique, 0))"
        met = f"aggregate({kept}, 0D, (a, x) -> a + x.df)"
        return F.struct((F.expr(met) * (1 + VERIFY_COST * REPEAT ** (m - 1))).alias("cost"), F.lit(m).alias("m"))

    chosen = ranked.withColumn("need", F.array_min(F.array(*[cost(m) for m in range(1, overlap + 1)]))["m"])
    prefix = chosen.withColumn("prefix", F.expr(f"slice(shared, 1, greatest(n - {overlap} + need - unique, 0))"))
    return prefix.select("id", "need", F.explode("prefix.token").alias("token"))


def candidate_pairs(sets: DataFrame, overlap: int) -> DataFrame:
    """``id_a < id_b`` of sets that may share at least ``overlap`` tokens: every pair that does, and
    those others whose prefixes meet often enough. Equal rows of ``id`` are one set; group equal
    sets beforehand, so that a pile of copies is one set here. Skewed tokens are left to AQE."""
    prefix = adaptive_prefixes(sets, overlap)
    a = prefix.select(F.col("id").alias("id_a"), "token", F.col("need").alias("need_a"))
    b = prefix.select(F.col("id").alias("id_b"), "token", F.col("need").alias("need_b"))
    met = a.join(b, "token").where("id_a < id_b")
    counted = met.groupBy("id_a", "id_b").agg(F.count("*").alias("met"), F.least(F.first("need_a"), F.first("need_b")).alias("need"))
    return counted.where("met >= need").select("id_a", "id_b")
