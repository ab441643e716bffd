"""Chunks, quotes with verified places, the graph of facts, sources and topics, and its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T


def chunk_spans(documents: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, chunk_index, start, chunk``: sliding pieces; blank ones are left out and do not count,
    and no piece starts after one that reaches the end. Null and empty texts give no row."""
    step = max(1, size - overlap)
    last = f"greatest(0, cast(ceil((length({text}) - {size}) / {step}D) as int))"
    starts = F.expr(f"transform(sequence(0, {last}), i -> i * {step})")
    pieces = F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(F.col(text), s + 1, F.lit(size)).alias("chunk"))), lambda p: F.length(T.strip(p["chunk"])) > 0)
    rows = documents.where(f"length({text}) > 0").select(key, F.posexplode(pieces).alias("chunk_index", "p"))
    return rows.select(key, "chunk_index", F.col("p.start").alias("start"), F.col("p.chunk").alias("chunk"))


def span_is_valid(text: Column, start: Column, end: Column, quote: Column, said_hash: Column | None = None) -> Column:
    """A quote stands at its place (code points from 0, end excluded), is not blank, and the text's
    hash is the one it was taken from."""
    ok = (start >= 0) & (end > start) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == quote) & (F.length(T.strip(quote)) > 0)
    if said_hash is not None:
        ok = ok & (T.content_hash(text) == said_hash)
    return F.coalesce(ok, F.lit(False))


def locate_quotes(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per claim of ``chunks`` (``chunk_id, fetch_id, claims``) joined to its source
    (``fetch_id, markdown``): place of the first occurrence, or -1, and the claim's id. Null quotes
    give no row; a claim without source is kept with start -1."""
    claims = chunks.select("chunk_id", "fetch_id", F.posexplode("claims").alias("claim_no", "c")).where("c.quote is not null")
    rows = claims.join(sources.select("fetch_id", "url", "markdown"), "fetch_id", "left")
    start = F.coalesce(F.instr(F.col("markdown"), F.col("c.quote")) - 1, F.lit(-1))
    sid = T.source_id(F.col("url"), F.col("markdown"))
    return rows.select("chunk_id", "claim_no", "fetch_id", F.col("c.quote").alias("quote"), F.col("c.topic").alias("topic"), start.alias("start"), sid.alias("source_id"), T.claim_id(sid, F.col("c.quote")).alias("claim_id"))


def facts_of(located: DataFrame) -> DataFrame:
    """Distinct verified claims: first place, last topic. Claims not found in their source are out."""
    found = located.where("start >= 0").withColumn("pos", F.struct("chunk_id", "claim_no"))
    return found.groupBy("claim_id").agg(
        F.min("pos").alias("pos"), F.max_by("topic", "pos").alias("topic"), F.min_by("quote", "pos").alias("quote"), F.min_by("source_id", "pos").alias("source_id"), F.min_by("start", "pos").alias("start")
    ).select("claim_id", "source_id", "quote", "start", "topic", F.col("pos.chunk_id").alias("chunk_id"), F.col("pos.claim_no").alias("claim_no"))


def ids_digest(ids: Column) -> Column:
    """Aggregate: a digest of a set of ids in hexadecimal (SHA-256 values) that does not depend on their
    order: the sum of their first 60 bits and their number, so that a node of any size needs two numbers."""
    return F.concat_ws("-", F.sum(F.conv(F.substring(ids, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string"), F.count(ids).cast("string"))


def topic_nodes(facts: DataFrame, title: str, families: DataFrame | None = None) -> DataFrame:
    """Per topic (``title`` where empty) the number of claims and sources, the least and greatest claim id
    and a digest of all of them. With ``families`` (``source_id, family``) reprints of one text are one
    source; a source without a family is its own."""
    source = F.col("source_id")
    if families is not None:
        facts, source = facts.join(families, "source_id", "left"), F.coalesce("family", "source_id")
    topic = F.coalesce(F.when(F.trim("topic") != "", F.trim("topic")), F.lit(title))
    return facts.withColumn("node", topic).groupBy("node").agg(
        F.count("*").alias("claims"), F.count_distinct(source).alias("sources"), F.min("claim_id").alias("first_claim"), F.max("claim_id").alias("last_claim"), ids_digest(F.col("claim_id")).alias("digest")
    )


def node_claims(facts: DataFrame, title: str) -> DataFrame:
    """``node, place, claim_id``: the claims of each topic in order of their ids, one row each. Ids are
    hashes, so a node is cut into 256 parts by its claims' first byte, which are numbered by themselves
    and moved by the sizes of the parts before: no task holds a node."""
    topic = F.coalesce(F.when(F.trim("topic") != "", F.trim("topic")), F.lit(title))
    rows = facts.select(topic.alias("node"), "claim_id").withColumn("part", F.substring("claim_id", 1, 2))
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy("node", "part").orderBy("claim_id")))
    before = rows.groupBy("node", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before, ["node", "part"]).select("node", (F.col("k") + F.col("before")).alias("place"), "claim_id")


def checked_citations(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """``claim_id, source_id, violation`` of each citation of ``facts`` (``claim_id, citations``: array of
    ``source_id, locator, content_sha256, start_offset, end_offset, text``): 'missing' source, other
    'locator', other 'hash', text that does not stand at its 'span', or null where all holds. A caller
    that must not go on with a broken graph passes the violations to :func:`assert_empty`."""
    each = facts.select("claim_id", F.explode("citations").alias("c"))
    own = sources.select(F.col("source_id").alias("sid"), F.col("locator").alias("said_locator"), "content_sha256", F.col("text").alias("body"))
    j = each.join(own, F.col("c.source_id") == F.col("sid"), "left")
    kind = (
        F.when(F.col("sid").isNull(), "missing")
        .when(~F.col("c.locator").eqNullSafe(F.col("said_locator")), "locator")
        .when(~F.col("c.content_sha256").eqNullSafe(F.col("content_sha256")), "hash")
        .when(~span_is_valid(F.col("body"), F.col("c.start_offset"), F.col("c.end_offset"), F.col("c.text")), "span")
    )
    return j.select("claim_id", F.col("c.source_id").alias("source_id"), kind.alias("violation"))


def merge_sources(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Keyed union of two source sets (``source_id, locator, content_sha256``): ``kind`` is 'new', 'kept',
    'same', or 'conflict' where the two disagree or the base has an id twice."""
    a = base.groupBy("source_id").agg(F.count("*").alias("n"), F.min(F.struct("locator", "content_sha256")).alias("a"))
    b = delta.groupBy("source_id").agg(F.count_distinct(F.struct("locator", "content_sha256")).alias("m"), F.min(F.struct("locator", "content_sha256")).alias("b"))
    j = a.join(b, "source_id", "full_outer")
    kind = F.when((F.col("n") > 1) | (F.col("m") > 1), "conflict").when(F.col("n").isNull(), "new").when(F.col("m").isNull(), "kept").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("conflict")
    return j.select("source_id", F.coalesce("a", "b").alias("r"), kind.alias("kind")).select("source_id", "r.locator", "r.content_sha256", "kind")


def exact_cover(expected: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """``key, expected, placed`` of what does not stand exactly once in ``placed``: left out, doubled or
    unknown. An empty result is an exact cover."""
    a = expected.groupBy(key).agg(F.count("*").alias("expected"))
    b = placed.groupBy(key).agg(F.count("*").alias("placed"))
    j = a.join(b, key, "full_outer").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("placed", F.lit(0)).alias("placed"))
    return j.where((F.col("expected") == 0) | (F.col("placed") != 1))


def set_difference(said: DataFrame, there: DataFrame, key: str, value: str) -> DataFrame:
    """``key, difference`` of a manifest (``said``) against what is there, one row a key in each:
    'missing', 'extra' or 'changed'. An empty result means equal sets."""
    j = said.select(key, F.col(value).alias("a")).join(there.select(key, F.col(value).alias("b")), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select(key, F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("changed").alias("difference"))


def coverage_gaps(nodes: DataFrame, least: int) -> DataFrame:
    """Topics with fewer than ``least`` distinct sources, as findings of high priority."""
    return nodes.where(F.col("sources") < least).select(F.concat(F.lit("coverage:"), "node").alias("finding_id"), F.lit("high").alias("priority"), F.col("sources"))


def gate(findings: DataFrame, max_high: int = 0, max_total: int = 0) -> DataFrame:
    """One row: CONTINUE while findings exceed either bound, else STOP_SUCCESS."""
    high = F.count_if(F.col("priority") == "high")
    return findings.agg(high.alias("high"), F.count("*").alias("total")).withColumn("verdict", F.when((F.col("high") > max_high) | (F.col("total") > max_total), "CONTINUE").otherwise("STOP_SUCCESS"))


def merge_facts(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Keyed union of two fact sets (``claim_id, quote, topic, source_id``): ``kind`` says whether a
    fact is new, skipped (already there; the old topic stays), kept, or in conflict (same id, other
    content). Callers must assert that no conflict is left before writing."""
    a, b = base.select("claim_id", *(F.col(c).alias(f"a_{c}") for c in ("quote", "topic", "source_id"))), delta.select("claim_id", *(F.col(c).alias(f"b_{c}") for c in ("quote", "topic", "source_id")))
    j = a.join(b, "claim_id", "full_outer")
    same = F.col("a_quote").eqNullSafe(F.col("b_quote")) & F.col("a_source_id").eqNullSafe(F.col("b_source_id"))
    kind = F.when(F.col("a_quote").isNull() & F.col("a_source_id").isNull(), "new_fact").when(F.col("b_quote").isNull() & F.col("b_source_id").isNull(), "kept").when(same, "skipped").otherwise("conflict")
    return j.select("claim_id", F.coalesce("a_quote", "b_quote").alias("quote"), F.coalesce("a_topic", "b_topic").alias("topic"), F.coalesce("a_source_id", "b_source_id").alias("source_id"), kind.alias("kind"))


def assert_empty(violations: DataFrame, what: str) -> None:
    """Fails when there is any violation; only the first row is looked for."""
    if not violations.isEmpty():
        raise ValueError(f"integrity violated: {what}")


def retained_findings(current: DataFrame, prior: DataFrame, resolutions: DataFrame, facts: DataFrame, new_claims: DataFrame) -> DataFrame:
    """Findings after a round: the current ones, and earlier model findings that were not resolved or
    were more urgent. ``current`` and ``prior`` have ``finding_id, priority, query``; a resolution
    (``finding_id, reason, claim_ids``) counts when it has a reason and names only known claims, of
    which at least one is new."""
    each = resolutions.where("trim(reason) <> ''").select("finding_id", F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    known = each.join(facts.select("claim_id", F.lit(True).alias("known")).distinct(), "claim_id", "left").join(new_claims.select("claim_id", F.lit(True).alias("fresh")).distinct(), "claim_id", "left")
    good = known.groupBy("finding_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"), F.bool_or(F.coalesce("fresh", F.lit(False))).alias("any_new")).where("all_known and any_new")
    open_ = prior.where("finding_id like 'model:%'").join(good, "finding_id", "left_anti")
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    both = current.withColumn("old", F.lit(1)).unionByName(open_.withColumn("old", F.lit(2)))
    # The more urgent one stays; at equal urgency the current one.
    return both.groupBy("finding_id").agg(F.min_by(F.struct("priority", "query"), F.struct(rank, F.col("old"))).alias("r")).select("finding_id", "r.priority", "r.query")


def targeted_queries(findings: DataFrame, most: int = 8) -> DataFrame:
    """Distinct queries of the findings in order of their ids, ``most`` of them."""
    q = F.trim("query")
    return findings.where(q != "").groupBy(q.alias("query")).agg(F.min("finding_id").alias("first_id")).orderBy("first_id", "query").limit(most)


def packed_paragraphs(text: Column, most: int = 3000) -> Column:
    """Paragraphs packed in order into pieces of at most ``most`` characters (a longer paragraph
    stands alone), as an array of strings."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s, p):
        full = s["open"].isNotNull() & (s["n"] + F.length(p) + 2 > most)
        done = F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        more = F.when(s["open"].isNull() | full, p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), more.alias("open"), (F.when(full, F.lit(0)).otherwise(s["n"]) + F.length(p) + 2).alias("n"))

    return F.aggregate(F.split(text, "\n\n", -1), state, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def merged_tags(*lists: Column) -> Column:
    """Tags of several lists, trimmed, the first spelling of each kept whatever its letter case."""
    every = F.filter(F.transform(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), lambda t: F.trim(t)), lambda t: t != "")
    lower = lambda a: F.transform(a, F.lower)
    return F.filter(every, lambda t, i: F.array_position(lower(every), F.lower(t)) == i + 1)
