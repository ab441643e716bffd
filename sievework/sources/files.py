"""Directories of Markdown and binary files as tables, and tables written back as files."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import urls as U


def read_markdown(spark: SparkSession, directory: str) -> DataFrame:
    """``name, text, locator, title, evidence_kind, body, content_sha256, source_id`` of each file."""
    raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    t, body = F.col("text"), T.body_of(F.col("text"))
    locator = F.coalesce(T.header_value(t, "source"), T.header_value(t, "locator"), T.header_value(t, "video_url"))
    return (
        raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
        .withColumn("locator", locator)
        .withColumn("title", F.coalesce(T.header_value(t, "title"), T.header_value(t, "video_title")))
        .withColumn("evidence_kind", T.header_value(t, "evidence_kind"))
        .withColumn("body", body)
        .withColumn("content_sha256", T.content_hash(F.col("body")))
        .withColumn("source_id", T.source_id(F.col("locator"), F.col("body")))
    )


def read_binaries(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, sha256`` of each file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def new_raw_files(hits: DataFrame, stored: DataFrame, last_index: int) -> DataFrame:
    """Hits (``url, place``) not stored yet, first of each URL, with file names that continue the
    index in order of the hits: ``NN-host-hash.md``."""
    fresh = hits.join(stored.select("url"), "url", "left_anti").groupBy("url").agg(F.min("place").alias("place"))
    number = F.row_number().over(Window.orderBy("place")) + last_index  # one run's new files
    name = F.concat(F.lpad(number.cast("string"), 2, "0"), F.lit("-"), U.host_of(F.col("url")), F.lit("-"), F.substring(F.sha2("url", 256), 1, 6), F.lit(".md"))
    return fresh.withColumn("name", name)


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` replaced by those of ``delta`` with the same key, new ones added."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def managed_block(page, block, name: str = "managed"):
    """The page with its marked block replaced, or with the block added at its end."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    wrapped = F.concat(F.lit(begin + "\n"), block, F.lit("\n" + end))
    has = page.contains(begin)
    head, tail = F.substring_index(page, begin, 1), F.regexp_extract(page, rf"(?s){end}(.*)$", 1)
    return F.when(has, F.concat(head, wrapped, tail)).otherwise(F.concat(page, F.lit("\n\n"), wrapped))


def topic_pages(facts: DataFrame) -> DataFrame:
    """``node, page``: Markdown of each topic with its claims in order of their ids. A topic's page
    holds the digest of every claim; its size is the size of the page that a reader gets."""
    line = F.concat(F.lit("- "), "quote", F.lit(" [source:"), "source_id", F.lit("]"))
    return facts.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("body")).select("node", F.concat(F.lit("# "), "node", F.lit("\n\n"), "body").alias("page"))


def package_id(files: DataFrame) -> str:
    """Id of a package: hash of its files' paths and hashes in order of the paths. Paths and hashes
    of one package are a manifest, which the driver writes in any case."""
    rows = files.select("path", "sha256", "bytes").orderBy("path").collect()
    core = json.dumps([r.asDict() for r in rows], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    import hashlib

    return "rp_" + hashlib.sha256(core.encode()).hexdigest()[:32]


def write_atomically(path: str, data: str) -> None:
    """Replaces a small file in one step, after it has reached the disk."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)
