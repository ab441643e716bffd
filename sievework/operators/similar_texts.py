"""Similar texts: exact Jaccard similarity of character shingles, found without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.components import connected_components
from sievework.operators.prefix_join import candidate_pairs
from sievework.session import spread, written

SHINGLE = 5
THRESHOLD = 0.85
#: A record's sketch: so many tokens of so many MinHash values each. Sets of Jaccard similarity 0.85
#: share 11 of the 40 tokens on average and fewer than ``OVERLAP`` five times in a hundred thousand pairs.
TOKENS, VALUES, OVERLAP = 40, 8, 2
#: As many candidates' ids as are broadcast; beyond that the texts are shuffled to them.
BROADCAST_IDS = 500_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the substrings of ``SHINGLE`` characters; a shorter text
    is its own only one, and an empty text has none."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if 0 < len(a) < SHINGLE:
        a = np.concatenate([a, np.full(SHINGLE - len(a), 1 << 32, np.uint64)])
    if not len(a):
        return np.empty(0, np.uint64)
    n = len(a) - SHINGLE + 1
    h = a[:n].copy()
    for i in range(1, SHINGLE):
        h *= _MUL
        h ^= a[i : n + i]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MUL
    return np.unique(h)


_BINS = TOKENS * VALUES
_EDGES = np.array([(i << 64) // _BINS for i in range(_BINS)], np.uint64)


_PROBES = np.random.default_rng(20).integers(0, _BINS, (40, _BINS))


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """Tokens of a set: one-permutation MinHash, an empty bin taking the value of the first bin that
    is not empty along its own fixed random sequence, so that small sets keep independent values."""
    if not len(hashes):
        return None
    at = np.append(np.searchsorted(hashes, _EDGES), len(hashes))
    filled = at[1:] > at[:-1]
    source = np.arange(_BINS)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        source[empty] = int(np.flatnonzero(filled)[0])
        for probe in _PROBES:
            to = probe[empty]
            done = filled[to]
            source[empty[done]] = to[done]
            empty = empty[~done]
            if not len(empty):
                break
    v = hashes[at[:-1][source]].reshape(TOKENS, VALUES)
    key = np.arange(TOKENS, dtype=np.uint64) * _MIX
    for j in range(VALUES):
        key = (key ^ v[:, j]) * _MUL
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, tokens."""
    for batch in batches:
        out = [sketch(shingle_hashes(t)) if t else None for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], ["id", "tokens"])


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, a = [], None, None
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if x != last:
                    last, a = x, shingle_hashes(x)
                b = shingle_hashes(y)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                if not len(small) or len(small) < threshold * len(large):
                    keep.append(False)
                    continue
                pos = np.searchsorted(large, small)
                pos[pos == len(large)] = 0
                both = int((large[pos] == small).sum())
                keep.append(both >= threshold * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id_a").filter(mask), batch.column("id_b").filter(mask)], ["id_a", "id_b"])

    return run


def similar_texts(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id_a < id_b`` of distinct texts (``id, text``, one row per text) whose character shingles
    have Jaccard similarity of at least ``threshold``; candidates by adaptive multi-match prefixes
    over the texts' sketches, then verified on the whole texts."""
    tokens = written(texts.select("id", "text").mapInArrow(_sketches, "id bigint, tokens array<bigint>").where("tokens is not null"), "sketches")
    pairs = written(candidate_pairs(tokens, OVERLAP), "candidates")
    ids = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).distinct()
    ids = written(ids, "candidate-ids")
    # Ids of eight bytes each: broadcast where there are few, so that only their texts are moved.
    used = texts.select("id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    both = pairs.join(used.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    both = both.join(used.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    return both.select("id_a", "id_b", "text_a", "text_b").mapInArrow(_verified(threshold), "id_a bigint, id_b bigint")


def near_duplicate_winners(documents: DataFrame, threshold: float = THRESHOLD, min_length: int = 200) -> DataFrame:
    """``doc_id, winner_id``: connected components of similar texts, each won by its longest text,
    ties by the least id. Texts shorter than ``min_length`` after normalisation win alone; equal
    texts are one before they are compared; a threshold of 0 or from 1 on keeps equal texts only."""
    rows = spread(documents.where("doc_id is not null and text is not null")).select("doc_id", T.normalized(F.col("text")).alias("t"), F.length("text").alias("n"))
    keyed = written(rows.withColumn("k", F.struct(F.xxhash64("t").alias("x"), F.hash("t").alias("h"), F.length("t").alias("m"))), "texts")
    long = keyed.where(F.length("t") >= min_length)
    first = long.groupBy("k").agg(F.min("doc_id").alias("first"))
    member = written(long.select("doc_id", "n", "k").join(first, "k").select("doc_id", "n", "first"), "members")
    edges = member.select(F.col("first").alias("a"), F.col("first").alias("b"))
    if 0 < threshold < 1:
        texts = keyed.join(member.where("doc_id = first").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("t").alias("text"))
        edges = edges.unionByName(similar_texts(texts, threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    comp = connected_components(edges).withColumnRenamed("id", "first")
    grouped = member.join(comp, "first")
    winner = grouped.groupBy("component").agg(F.min_by("doc_id", F.struct(-F.col("n"), F.col("doc_id"))).alias("winner_id"))
    won = grouped.join(winner, "component").select("doc_id", "winner_id")
    return won.unionByName(keyed.where(F.length("t") < min_length).select("doc_id", F.col("doc_id").alias("winner_id")))


FAMILY_SHINGLE, FAMILY_THRESHOLD = 7, 0.98


def _same_family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
            a, b = ({t[i : i + FAMILY_SHINGLE] for i in range(max(1, len(t) - FAMILY_SHINGLE + 1))} for t in (x, y))
            keep.append(len(a & b) >= FAMILY_THRESHOLD * len(a | b))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("id_a", "id_b")], ["id_a", "id_b"])


def first_leaders(links: DataFrame) -> DataFrame | None:
    """``id_b, family``: what leader clustering in order of id gives for links ``id_a < id_b``; a
    source not listed leads. None without links.

    In each round every source whose earlier neighbours are all out leads, and a source joins its
    least leader when no undecided neighbour precedes that one. The least open source is decided in
    every round, so the loop ends; a chain of n revisions takes n / 2 rounds.
    """
    leaders, open_links = None, links.withColumn("led", F.lit(False))
    while not open_links.isEmpty():
        later = open_links.select(F.col("id_b").alias("id_a")).distinct().withColumn("later", F.lit(True))
        marked = written(open_links.join(later, "id_a", "left").select("id_a", "id_b", (F.col("led") | F.col("later").isNull()).alias("led")), "family-marked")
        least = marked.groupBy("id_b").agg(F.min(F.when(F.col("led"), F.col("id_a"))).alias("family"), F.min(F.when(~F.col("led"), F.col("id_a"))).alias("undecided"))
        joined = written(least.where("family is not null and (undecided is null or family < undecided)").select("id_b", "family"), "joined")
        if joined.isEmpty():
            raise RuntimeError("leader clustering stands still with links open")
        leaders = joined if leaders is None else leaders.unionByName(joined)
        gone = joined.select("id_b")
        rest = marked.join(gone, "id_b", "left_anti").join(gone.withColumnRenamed("id_b", "id_a"), "id_a", "left_anti")
        open_links = written(rest.select("id_a", "id_b", "led"), "family-links")
    return leaders


def content_families(sources: DataFrame) -> DataFrame:
    """``id, family`` by leader clustering in order of ``id``: a source joins the first earlier leader
    whose 7-character shingles are similar by at least 0.98, else it leads a family of its own.

    The order is kept without going through the sources one by one: see :func:`first_leaders`.
    ``sources`` has ``id, text``; null texts give no row, equal texts share a leader.
    """
    rows = sources.where("id is not null and text is not null").select("id", T.normalized(F.col("text")).alias("t"))
    keyed = written(rows.withColumn("k", F.struct(F.xxhash64("t").alias("x"), F.hash("t").alias("h"), F.length("t").alias("m"))), "texts")
    first = written(keyed.groupBy("k").agg(F.min("id").alias("lead")), "leads")
    texts = keyed.join(first, (keyed.k == first.k) & (keyed.id == first.lead), "left_semi").select("id", F.col("t").alias("text"))
    near = written(similar_texts(texts, 0.9), "near")
    both = near.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    links = written(both.select("id_a", "id_b", "text_a", "text_b").mapInArrow(_same_family, "id_a bigint, id_b bigint"), "family-links")
    leaders = first_leaders(links)
    mapped = first.select("k", "lead") if leaders is None else first.join(leaders, first.lead == leaders.id_b, "left").select("k", F.coalesce("family", "lead").alias("lead"))
    return keyed.join(mapped, "k").select("id", F.col("lead").alias("family"))
