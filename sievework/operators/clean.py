"""Cleaning of document bodies, line by line, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.urls import let


def drop_ads(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(T.AD_WORDS))


def menu_marks(sizes: Column) -> Column:
    """For lines of the given lengths one letter each, 'x' where a line stands in a menu: a run of at
    least three lines that are not blank of which 70 % are short. Runs are found in one string with a
    letter a line, so the work grows with the number of lines."""
    code = F.array_join(F.transform(sizes, lambda n: F.when(n == 0, "b").when(n < T.SHORT_LINE, "s").otherwise("l")), "")
    runs = F.regexp_extract_all(code, F.lit("[sl]+|b+"), F.lit(0))

    def marked(run):
        short = F.length(run) - F.length(F.replace(run, F.lit("s"), F.lit("")))
        menu = ~run.startswith("b") & (F.length(run) >= T.MENU_RUN) & (short >= T.MENU_SHARE * F.length(run))
        return F.when(menu, F.translate(run, "sl", "xx")).otherwise(run)

    return F.split(F.array_join(F.transform(runs, marked), ""), "")


def from_content_start(lines: Column) -> Column:
    """From the first line that is no link and either a sentence of 40 characters or 120 long."""
    def starts(x):
        size = F.length(T.strip(x))
        # The raw length is looked at first: it is cheap and no less than the stripped one.
        return F.when(F.length(x) < T.SHORT_LINE, F.lit(False)).otherwise(((size >= T.CONTENT_LENGTH) | ((size >= T.SHORT_LINE) & x.rlike(T.SENTENCE_MARK))) & ~T.is_link_line(x))

    at = F.array_position(F.transform(lines, starts), True).cast("int")
    return F.when(at > 0, F.slice(lines, at, 1_000_000_000)).otherwise(lines)


def to_tail(lines: Column) -> Column:
    """Up to the first heading of closing sections."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(T.TAIL_HEADING)), True).cast("int")
    return F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)


def clean_documents(documents: DataFrame, text: str = "text", min_length: int = 200) -> DataFrame:
    """Adds ``cleaned`` (body without markup, ads, menus and tail), ``original_size``,
    ``cleaned_size``, ``ratio`` (3 places) and ``issues``. A binary body cleans to ''. Null text
    gives null and no issue; one projection, no shuffle."""
    # Each step is a column of its own: one that is used twice is then computed once.
    out = documents.withColumn("_body", T.body_of(F.col(text))).withColumn("_binary", T.looks_binary(F.col("_body")))
    out = out.withColumn("_lines", drop_ads(T.lines_of(T.unescape(T.strip_html(F.col("_body"))))))
    sizes = F.transform("_lines", lambda x: F.length(T.strip(x)))
    # The marks are bound once: a column used in the lambda would be put in its place and computed for each line.
    out = out.withColumn("_lines", let(menu_marks(sizes), lambda marks: F.filter("_lines", lambda x, i: F.get(marks, i) != "x")))
    for f in (from_content_start, to_tail):
        out = out.withColumn("_lines", f(F.col("_lines")))
    joined = F.substring(T.strip(F.regexp_replace(F.array_join("_lines", "\n"), r"\n{3,}", "\n\n")), 1, T.MAX_CONTENT)
    out = out.withColumn("cleaned", F.when(F.col("_binary"), F.lit("")).otherwise(joined))
    size, original = F.length("cleaned"), F.length(text)
    issues = F.filter(F.array(F.when(F.col("_binary"), "binary_or_unparsed_pdf"), F.when(size < min_length, "too_short")), lambda x: x.isNotNull())
    return (
        out.withColumn("original_size", original.cast("bigint"))
        .withColumn("cleaned_size", size.cast("bigint"))
        .withColumn("ratio", F.when(original > 0, F.round(size / original, 3)).otherwise(F.lit(0.0)))
        .withColumn("issues", issues)
        .drop("_binary", "_body", "_lines")
    )
