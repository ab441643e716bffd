"""Problem 3: records that are slightly changed copies of each other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.urls import page_key
from sievework.llm.pages import analysed_pages, leftover_pages, one_page_each, readable
from sievework.operators.similar_texts import THRESHOLD, similar_texts
from sievework.session import written


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fetch_id, markdown, gone -> fetch_id, body: without the lines ``gone``, in lower case and with
    white space runs as one space."""
    for batch in batches:
        bodies = []
        for text, gone in zip(batch.column("markdown").to_pylist(), batch.column("gone").to_pylist()):
            drop = set(gone)
            bodies.append(" ".join("\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop]).split()).lower())
        yield pa.RecordBatch.from_arrays([batch.column("fetch_id"), pa.array(bodies, pa.string())], ["fetch_id", "body"])


def page_bodies(pages: DataFrame) -> DataFrame:
    """``fetch_id, body``: main body of each page in lower case with white space runs as one space.
    Blank pages, leftover pages and pages with an empty body give no row. Texts are moved once, to the
    numbers of the lines they lose."""
    analysed = analysed_pages(pages)
    good = analysed.join(leftover_pages(analysed), "fetch_id", "left_anti")
    gone = good.select("fetch_id", F.expr("transform(filter(lines, x -> x.outside), x -> x.line_no)").alias("gone"))
    rows = readable(one_page_each(pages)).select("fetch_id", "markdown").join(gone, "fetch_id")
    return rows.select("fetch_id", "markdown", "gone").mapInArrow(_bodies, "fetch_id bigint, body string").where("body <> ''")


def similar_pages(pages: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of equal main bodies (``fetch_id, class_id``; the least ``fetch_id`` names the class)
    and pairs of similar classes (``id_a < id_b``)."""
    key = F.struct(F.xxhash64("body").alias("x"), F.length("body").alias("n"), F.hash("body").alias("h"))
    keyed = written(page_bodies(pages).withColumn("k", key), "bodies")
    ids = keyed.select("fetch_id", "k")
    least = ids.groupBy("k").agg(F.min("fetch_id").alias("class_id"))
    classes = written(ids.join(least, "k").select("fetch_id", "class_id").distinct(), "classes")
    copies = written(classes.where("fetch_id <> class_id").select("fetch_id"), "copies")
    texts = keyed.join(copies, "fetch_id", "left_anti").select(F.col("fetch_id").alias("id"), F.col("body").alias("text"))
    return classes, similar_texts(texts, threshold)


def _hit_keys(hits: DataFrame) -> DataFrame:
    """``hit_id, k, h``: two hashes of the page that each URL addresses; one row per id and page."""
    key = page_key(F.col("url"))
    return hits.where("url is not null and hit_id is not null").select("hit_id", F.xxhash64(key).alias("k"), F.hash(key).alias("h")).distinct()


def near_duplicate_pairs(pages: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``record_kind, id_a, id_b``: pages that are slightly changed copies, and hits whose URLs
    address one page. Null URLs, blank and leftover pages take no part; each pair is listed once."""
    classes, similar = similar_pages(pages, threshold)
    equal = similar.unionByName(classes.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("id_a"), F.col("class_id").alias("id_b")))
    a = classes.select(F.col("class_id").alias("id_a"), F.col("fetch_id").alias("x"))
    b = classes.select(F.col("class_id").alias("id_b"), F.col("fetch_id").alias("y"))
    found = equal.join(a, "id_a").join(b, "id_b").where("id_a <> id_b or x < y")
    fetch = found.select(F.lit("fetch").alias("record_kind"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    shared = _hit_keys(hits)
    hit = shared.select(F.col("hit_id").alias("id_a"), "k", "h").join(shared.select(F.col("hit_id").alias("id_b"), "k", "h"), ["k", "h"]).where("id_a < id_b")
    return fetch.distinct().unionByName(hit.select(F.lit("hit").alias("record_kind"), "id_a", "id_b"))


def near_duplicate_classes(pages: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``record_kind, id, class_id, links``: one row per record that takes part, its group of copies
    named by the least id of equal records, and the number of other groups that are similar to it. The
    whole of :func:`near_duplicate_pairs` without writing out the pairs within a group."""
    classes, similar = similar_pages(pages, threshold)
    similar = written(similar, "similar")
    ends = similar.select(F.col("id_a").alias("class_id")).unionByName(similar.select(F.col("id_b").alias("class_id")))
    fetch = classes.join(ends.groupBy("class_id").agg(F.count("*").alias("links")), "class_id", "left")
    fetch = fetch.select(F.lit("fetch").alias("record_kind"), F.col("fetch_id").alias("id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    keyed = _hit_keys(hits)
    least = keyed.groupBy("k", "h").agg(F.min("hit_id").alias("class_id"))
    hit = keyed.join(least, ["k", "h"]).select(F.lit("hit").alias("record_kind"), F.col("hit_id").alias("id"), "class_id", F.lit(0).cast("bigint").alias("links"))
    return fetch.unionByName(hit)
