"""One pass over fetched pages, what is counted over the lines of a site, and where each page's main
body lies.

``page_lines`` reads each page once (Arrow batches) and keeps only numbers about its lines, so that
later shuffles move keys of eight bytes instead of text. ``analysed_pages`` adds what the site's pages
say about each line and runs the density tree of :mod:`sievework.llm.page_text` over the numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import page_text as T
from sievework.operators.components import connected_components
from sievework.session import spread, written

#: A line is recurrent when at least so many pages of its site hold it.
MIN_PAGES = 6
#: A line of a small site is recurrent when it stands in ``MIN_PAGES`` articles of so many sites.
MIN_SITES = 3
#: A recurrent line heads a block of links when on this share of its places the line right below it is
#: one that stands below it nowhere else on the site.
HEADS_SHARE = 0.4
#: Two pages are copies when they share this share of their prose in lines that recur.
COPY_SHARE = 0.5
#: A recurrent line is boilerplate that says nothing about a page when this share of the pages that
#: hold it are articles beside it; an error text, which stands alone on most, still counts as evidence.
BOILERPLATE_SHARE = 0.5
#: A page with evidence of leftovers is excluded unless so much prose (weighted characters) is left.
MIN_PROSE = 120
#: MinHash values of a line's masked text: ``BANDS`` bands of ``ROWS`` values.
BANDS, ROWS = 6, 2
BAND_COLUMNS = tuple(f"values{k}" for k in range(BANDS * ROWS // 4))

_LINE_COLUMNS = {
    "line_no": "int", "line_key": "bigint", "cross_key": "bigint", "label_key": "bigint", "next_key": "bigint", "first": "boolean", "run": "int", "kind": "int",
    "size": "int", "own": "int", "other": "int", "tags": "int", "signed": "boolean", "evidence": "int", "prose": "int", "sentence": "boolean",
}
_EVIDENCE, _PROSE, _SENTENCE, _FIRST = (list(_LINE_COLUMNS).index(c) for c in ("evidence", "prose", "sentence", "first"))
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _schema(bands: bool) -> str:
    columns = {**_LINE_COLUMNS, **(dict.fromkeys(BAND_COLUMNS, "bigint") if bands else {})}
    return f"fetch_id bigint, site string, suspect boolean, said bigint, lines array<struct<{', '.join(f'{c}:{t}' for c, t in columns.items())}>>"



_A = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B1) | np.uint64(1)).astype(np.uint32)


def site_of(url: Column, site: Column) -> Column:
    """The host in lower case without a leading ``www.``; ``site`` where it is given."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.", "")
    return F.coalesce(F.when(F.trim(site) != "", site), F.when(host != "", host), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def min_hashes(lines: list[bytes]) -> np.ndarray:
    """``BANDS * ROWS`` MinHash values of each line over its four-byte shingles; a shorter line counts
    as one shingle padded with a byte that no text holds. No shingle runs from one line into the next."""
    n = len(lines)
    out = np.empty((n, BANDS * ROWS), np.uint32)
    a = 0
    while a < n:
        size, b = 0, a
        while b < n and (size < 1 << 20 or b == a):
            size += max(len(lines[b]), 4)
            b += 1
        padded = [x if len(x) >= 4 else x.ljust(4, b"\xff") for x in lines[a:b]]
        buf = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
        lengths = np.fromiter(map(len, padded), np.int64, b - a)
        grams = buf[:-3] | buf[1:-2] << 8 | buf[2:-1] << 16 | buf[3:] << 24
        ends = np.cumsum(lengths)
        keep = np.ones(len(grams), bool)
        for back in (3, 2, 1):
            at = ends[:-1] - back
            keep[at[(at >= 0) & (at < len(grams))]] = False
        grams = grams[keep]
        starts = np.concatenate(([0], np.cumsum(lengths - 3)[:-1]))
        grams = (grams ^ grams >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        grams ^= grams >> np.uint32(12)
        for j, m in enumerate(_A):
            mixed = (grams + m) * (m | np.uint32(1))
            mixed ^= mixed >> np.uint32(16)
            out[a:b, j] = np.minimum.reduceat(mixed * np.uint32(0x85EBCA6B), starts)
        a = b
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """Sixteen bits of each MinHash value, four values to a number."""
    low = (values & np.uint32(0xFFFF)).astype(np.uint64).reshape(len(values), -1, 4)
    return (low << (np.arange(4, dtype=np.uint64) * np.uint64(16))).sum(axis=2, dtype=np.uint64).view(np.int64)


def bucket_keys() -> Column:
    """The LSH buckets of a line: site and the values of each band, from its packed values."""
    return F.array(*(F.xxhash64("site", F.lit(k), F.expr(f"(values{k // 2} >> {32 * (k % 2)}) & 4294967295")) for k in range(BANDS)))


def _structs(offsets, arrays: list[pa.Array], names) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names=list(names)))


def _analyse(bands: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, sites, urls, texts = (batch.column(k) for k in range(4))
                offsets, rows, masked, suspect, said = [0], [], [], [], []
                for url, site, text in zip(urls.to_pylist(), sites.to_pylist(), texts.to_pylist()):
                    words = T.site_words(url, site)
                    prefix = (site + "\0").encode("utf-8", "replace")
                    lines = text.split("\n")
                    seen, block, before, begin = set(), 0, None, len(rows)
                    for no, (line, kind) in enumerate(zip(lines, T.kinds_of(lines))):
                        if kind == T.NONE:
                            block, before = block + 1, None
                            continue
                        if not T.has_letter(line):
                            continue
                        low = line.lower()
                        norm = T.norm_lower(low)
                        raw = norm.encode("utf-8", "replace")
                        key = _signed(digest(prefix + raw))
                        named = T.without_names(norm, words)
                        cross = _signed(digest(raw if named is norm else named.encode("utf-8", "replace")))
                        label = T.label_of(line, kind)
                        label_key = _signed(digest(prefix + b"\1" + label.encode("utf-8", "replace"))) if label else 0
                        size, own, other, links = T.links_of(line, site) if "](" in line else (len(line.strip()), 0, 0, 0)
                        ev, held = T.line_evidence(line, low)
                        prose = 0
                        if kind not in (T.HEAD, T.TITLE) and not ev & (T.EV_PLACEHOLDER | T.EV_FILLER):
                            prose = max(0, T.prose_weight(line) - held)
                        if before is not None and kind not in (T.TITLE, T.CODE, T.TABLE):
                            rows[before] = (*rows[before][:4], label_key or key, *rows[before][5:])
                        before = len(rows)
                        rows.append((no, key, cross, label_key, 0, key not in seen, block, kind, size, own, other, 1 + links,
                                     kind == T.PROSE and T.is_signed(line, words), ev, prose, kind in (T.PROSE, T.QUOTE, T.ITEM) and T.is_sentence(line)))
                        seen.add(key)
                        if bands:
                            masked.append(T.masked_line(line, norm).encode("utf-8", "replace"))
                    offsets.append(len(rows))
                    suspect.append(any(x[_EVIDENCE] for x in rows[begin:]))
                    said.append(sum(x[_PROSE] for x in rows[begin:] if x[_SENTENCE] and x[_FIRST]))
                columns = zip(*rows) if rows else ((),) * len(_LINE_COLUMNS)
                arrays = [pa.array(c, _ARROW[t]) for c, t in zip(columns, _LINE_COLUMNS.values())]
                if bands:
                    values = packed(min_hashes(masked) if masked else np.empty((0, BANDS * ROWS), np.uint32))
                    arrays += [pa.array(np.ascontiguousarray(x), pa.int64()) for x in values.T]
                out = [ids, sites, pa.array(suspect, pa.bool_()), pa.array(said, pa.int64()), _structs(offsets, arrays, (*_LINE_COLUMNS, *(BAND_COLUMNS if bands else ())))]
                yield pa.RecordBatch.from_arrays(out, ["fetch_id", "site", "suspect", "said", "lines"])

    return run


def readable(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("fetch_id").isNotNull() & F.col("markdown").rlike(r"(?U)\S"))


def page_lines(pages: DataFrame, bands: bool = False) -> DataFrame:
    """One row per page that is not blank: what its lines with letters are.

    Input columns ``fetch_id, url, site, markdown``; others are ignored. Null and blank ``markdown``
    give no row; a null ``site`` is taken from ``url`` and is '' where that is null too. With
    ``bands`` each line also gets the MinHash values of its masked text.
    """
    rows = readable(pages).select("fetch_id", site_of(F.col("url"), F.col("site")).alias("site"), "url", "markdown")
    return spread(rows).mapInArrow(_analyse(bands), _schema(bands))


def one_page_each(pages: DataFrame) -> DataFrame:
    """``pages`` with one row per ``fetch_id``: of repeated rows of an id the one whose ``markdown``,
    ``url`` and ``site`` come first in order. Where ids do not repeat, as they should not, nothing is
    moved; the ids alone are counted to know."""
    rows, ids = pages.agg(F.count("fetch_id"), F.count_distinct("fetch_id")).first()
    if rows == ids:
        return pages
    first = F.min(F.struct("markdown", "url", "site")).alias("r")
    return pages.where(F.col("markdown").isNotNull()).groupBy("fetch_id").agg(first).select("fetch_id", "r.markdown", "r.url", "r.site")


def exploded(pages: DataFrame, *names: str, where: str | None = None) -> DataFrame:
    """One row per line of ``page_lines`` (where one is given, of those it holds for), with the line
    columns ``names``; ``site`` is a number here, since aggregates of numbers need no sort."""
    each = pages.select("fetch_id", F.xxhash64("site").alias("site"), F.explode("lines").alias("l"))
    return (each if where is None else each.where(where)).select("fetch_id", "site", *(F.col(f"l.{n}").alias(n) for n in names))


def _copies(held: DataFrame, lines: DataFrame) -> DataFrame | None:
    """``fetch_id, article`` of pages that are copies of each other; None where there are none.

    Pages that share a recurrent sentence are compared with the least page that holds it, not with
    each other, so a group of n copies costs n comparisons a line."""
    weight = lines.select("fetch_id", F.col("said").alias("all"))
    said = held.where("sentence and prose > 0").select("fetch_id", "cross_key", "prose")
    mostly = said.groupBy("fetch_id").agg(F.sum("prose").alias("w")).join(weight, "fetch_id").where(F.col("w") >= COPY_SHARE * F.col("all")).select("fetch_id", "all")
    mostly = written(mostly, "mostly-recurrent")
    if mostly.isEmpty():
        return None
    said = said.join(mostly, "fetch_id")
    first = said.groupBy("cross_key").agg(F.min(F.struct("fetch_id", "all")).alias("f")).select("cross_key", F.col("f.fetch_id").alias("b"), F.col("f.all").alias("all_b"))
    pairs = said.join(first, "cross_key").groupBy(F.col("fetch_id").alias("a"), "b").agg(F.sum("prose").alias("w"), F.first("all").alias("all"), F.first("all_b").alias("all_b"))
    edges = written(pairs.where(F.col("w") >= COPY_SHARE * F.greatest("all", "all_b")).select("a", "b"), "copy-edges")
    return connected_components(edges).select(F.col("id").alias("fetch_id"), F.col("component").alias("article"))


def site_lines(lines: DataFrame, of: DataFrame | None = None, least: int = MIN_PAGES) -> DataFrame:
    """``line_key, bits``: what the pages of a site say about its lines (``RECURS``, ``HEADS``,
    ``LABELLED`` of :mod:`sievework.llm.page_text`). With ``of``, only about the lines of those pages,
    counted over all pages all the same.

    A line recurs when at least ``least`` different articles of its site hold it, or as many articles
    of ``MIN_SITES`` sites, with the names by which sites call themselves masked. Copies of one
    article, however many, are one article. A line is labelled when the label that opens it does so in
    ``least`` articles. A recurrent line is a heading when what follows it right below keeps changing.
    """
    once = exploded(lines, "line_key", "cross_key", "next_key", "prose", "sentence", where="l.first")
    keys = exploded(lines, "line_key", "cross_key", where="l.first")
    labels = exploded(lines, "line_key", "label_key", where="l.first and l.label_key <> 0")
    if of is not None:
        asked = written(exploded(of, "line_key", "cross_key", "label_key").select("line_key", "cross_key", "label_key").distinct(), "asked")
        keys = keys.join(asked.select("cross_key").distinct(), "cross_key", "left_semi")
        labels = labels.join(asked.select("label_key").distinct(), "label_key", "left_semi")
    per_key = keys.groupBy("line_key").agg(F.count("*").alias("pages"), F.max("cross_key").alias("cross_key"), F.max("site").alias("site"))
    # Lines that recur on one site, and those of small sites that recur over sites, before copies are told.
    over = per_key.groupBy("cross_key").agg(F.sum("pages").alias("all"), F.count_distinct("site").alias("sites")).where((F.col("all") >= least) & (F.col("sites") >= MIN_SITES))
    recurrent = written(per_key.where(F.col("pages") >= least).select("line_key").unionByName(per_key.join(over.select("cross_key"), "cross_key", "left_semi").select("line_key")).distinct(), "recurrent")
    held = written(once.join(recurrent, "line_key", "left_semi").select("fetch_id", "site", "line_key", "cross_key", "next_key", "prose", "sentence"), "held")
    article = None if of is not None else _copies(held, lines)
    votes, tagged, voter = held, labels, F.col("fetch_id")
    if article is not None:
        article = written(article, "articles")
        votes, tagged, voter = votes.join(article, "fetch_id", "left"), tagged.join(article, "fetch_id", "left"), F.coalesce("article", "fetch_id")
    votes = votes.groupBy("line_key", "cross_key", "site", voter.alias("article")).agg(F.max("next_key").alias("next_key"))
    here = votes.groupBy("line_key").agg(F.count("*").alias("n"), F.max("cross_key").alias("cross_key"), F.count_distinct(F.when(F.col("next_key") != 0, F.col("next_key"))).alias("below"))
    cross = votes.groupBy("cross_key").agg(F.count_distinct("site").alias("sites"), F.count_distinct("article").alias("everywhere")).where((F.col("sites") >= MIN_SITES) & (F.col("everywhere") >= least))
    recurs = here.join(cross, "cross_key", "left").where((F.col("n") >= least) | F.col("sites").isNotNull())
    recurs = recurs.select("line_key", F.when((F.col("below") - 1) / F.col("n") >= HEADS_SHARE, T.RECURS | T.HEADS).otherwise(T.RECURS).alias("bits"))
    often = tagged.groupBy("label_key").agg(F.count_distinct(voter).alias("n")).where(F.col("n") >= least)
    labelled = labels.join(often, "label_key", "left_semi").select("line_key", F.lit(T.LABELLED).alias("bits")).distinct()
    return written(recurs.unionByName(labelled).groupBy("line_key").agg(F.bit_or("bits").alias("bits")), "site-lines")


def _density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = ("line_key", "run", "kind", "size", "own", "other", "tags", "signed", "evidence", "prose")
    for batch in batches:
        lines = batch.column("lines")
        flat = lines.flatten()
        keys, runs, kinds, sizes, owns, others, tags, signed, evidence, prose = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in read)
        ends = np.cumsum(lines.value_lengths().to_numpy()).tolist()
        marks, marked = batch.column("marks"), {}
        if marks.null_count < batch.num_rows:
            lengths = marks.value_lengths().fill_null(0).to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lengths).tolist()
            inside = marks.flatten()
            marked = {(r, k): b for r, k, b in zip(owner, inside.field("line_key").to_pylist(), inside.field("bits").to_pylist())}
        outside, own_prose, evident, a = [], [], [], 0
        for r, b in enumerate(ends):
            bits = [marked.get((r, k), 0) for k in keys[a:b]]
            if True in signed[a:b]:
                bits = [x | T.SIGNED if s else x for x, s in zip(bits, signed[a:b])]
            out = T.outside_lines(runs[a:b], kinds[a:b], sizes[a:b], owns[a:b], others[a:b], tags[a:b], bits)
            outside += out
            own_prose.append(sum(p for p, o, x in zip(prose[a:b], out, bits) if p and not o and not x & T.RECURS))
            evident.append([k for k, e in zip(keys[a:b], evidence[a:b]) if e] if any(evidence[a:b]) else [])
            a = b
        told = _structs([0, *ends], [flat.field("line_no"), flat.field("line_key"), pa.array(outside, pa.bool_())], ("line_no", "line_key", "outside"))
        yield pa.RecordBatch.from_arrays([batch.column("fetch_id"), batch.column("site"), told, pa.array(own_prose, pa.int64()), pa.array(evident, pa.list_(pa.int64()))], ["fetch_id", "site", "lines", "own_prose", "evident"])


def _analysed(lines: DataFrame, marks: DataFrame | None) -> DataFrame:
    """The density tree over ``page_lines`` with the ``bits`` of their lines."""
    if marks is None:
        lines = lines.withColumn("marks", F.lit(None).cast("array<struct<line_key:bigint,bits:int>>"))
    else:
        held = exploded(lines, "line_key", where="l.first").join(marks, "line_key").groupBy("fetch_id").agg(F.collect_list(F.struct("line_key", "bits")).alias("marks"))
        lines = lines.join(held, "fetch_id", "left")
    return lines.select("fetch_id", "site", "lines", "marks").mapInArrow(_density, "fetch_id bigint, site string, lines array<struct<line_no:int,line_key:bigint,outside:boolean>>, own_prose bigint, evident array<bigint>")


def analysed_pages(pages: DataFrame, learn: bool = True) -> DataFrame:
    """One row per page that is not blank, written: ``fetch_id, site``, its lines with letters
    (``lines``: ``line_no, line_key, outside``), the prose of its main body that does not recur
    (``own_prose``) and the keys of its lines that are evidence (``evident``).

    Without ``learn`` nothing is learned from the site's other pages: density sees links only."""
    lines = written(page_lines(one_page_each(pages)), "page-lines")
    return written(_analysed(lines, site_lines(lines) if learn else None), "analysed")


def lines_and_leftovers(pages: DataFrame, bands: bool = False) -> tuple[DataFrame, DataFrame]:
    """``page_lines``, written, and the leftover pages among them. Only pages with evidence need their
    main body for that, so density is taken on those alone."""
    lines = written(page_lines(one_page_each(pages), bands), "page-lines")
    suspects = written(lines.where("suspect"), "suspects")
    return lines, leftover_pages(_analysed(suspects, site_lines(lines, suspects)))


def leftover_pages(pages: DataFrame, share: float = BOILERPLATE_SHARE, min_prose: int = MIN_PROSE) -> DataFrame:
    """``fetch_id`` of the ``analysed_pages`` that hold leftovers or notices where content should be.

    A line of evidence is boilerplate and is subtracted when at least ``MIN_PAGES`` pages, and at
    least ``share`` of all pages that hold it, have ``min_prose`` weighted characters of prose of
    their own beside it. A notice that recurs where nothing else stands stays evidence, however often
    it does. A page is excluded when a line of the rest is evidence (unfilled placeholder, filler
    text, error or access notice, call to switch on scripts) and its main body has less than
    ``min_prose`` weighted characters of prose beside it.
    """
    held = written(pages.where(F.size("evident") > 0).select("fetch_id", "own_prose", F.explode(F.array_distinct("evident")).alias("line_key")), "evident")
    of_line = held.groupBy("line_key").agg(F.count("*").alias("n"), F.count_if(F.col("own_prose") >= min_prose).alias("articles"))
    boiler = of_line.where((F.col("articles") >= MIN_PAGES) & (F.col("articles") >= F.col("n") * share)).select("line_key")
    return written(held.where(F.col("own_prose") < min_prose).join(boiler, "line_key", "left_anti").select("fetch_id").distinct(), "leftovers")
