"""Problem 6: cutting oversized items at natural boundaries."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_LIMIT, TEXT_OVERLAP = 4000, 200
CLAIM_LIMIT = 1500
PIECES = "array<struct<piece_no:int,start:int,end:int,first_claim:int,last_claim:int,boundary:int>>"

# A boundary ends where its match ends: blank line, line, sentence, white space, and a stop inside a token.
_BOUNDARY = re.compile(r"(\n[^\S\n]*\n\s*)|(\n)|([.!?]+[\"'”’»)\]]*(?:[^\S\n]|(?=\n)|\Z)|[。！？][”’」』）]*)|(\s)|([.!?]+)")
PARAGRAPH, LINE, SENTENCE, SPACE, TOKEN, FORCED = 5, 4, 3, 2, 1, 0
#: A cut moves from its target by up to this share of a piece's length.
SLACK = 0.15


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Positions at which a piece may end, their strengths, and where the marks before them begin."""
    at, strength, begin = [], [], []
    for m in _BOUNDARY.finditer(text):
        at.append(m.end())
        strength.append(6 - m.lastindex)
        begin.append(m.start())
    return at, strength, begin


def split_text(text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, end, boundary)`` of pieces of at most ``limit`` characters, neighbours sharing
    ``overlap`` characters; ``boundary`` is the strength at the piece's end (0: cut within a word).

    The least number of pieces for what is left sets targets of equal lengths, and the next cut moves
    to the strongest boundary near its target. Where that is weaker than a sentence's end, targets of
    one piece more are tried, and where none is in reach any boundary that keeps the limit. Pieces share
    less than ``overlap`` only where a stretch without a boundary would not fit otherwise; so a cut is
    forced only in a stretch longer than ``limit``.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH)] if n else []
    at, strength, begin = boundaries(text)
    start, end, out = 0, 0, []
    while n - start > limit:
        left = n - start
        least = max(2, math.ceil((left - overlap) / (limit - overlap)))
        cut, kind = None, FORCED
        for k in (least, least + 1):
            even = (left + (k - 1) * overlap) / k
            target, slack = start + even, max(even * SLACK, limit - even if k == least else 0)
            fit = n - (k - 1) * (limit - overlap)  # an earlier cut would leave too much for k - 1 pieces
            low, high = max(fit, target - slack, end + 1, start + overlap + 1), min(start + limit, target + slack, n - 1)
            a, b = bisect_left(at, low), bisect_right(at, high)
            if a < b:
                j = max(range(a, b), key=lambda x: (strength[x], -abs(at[x] - target)))  # noqa: B023
                if strength[j] > kind:
                    cut, kind = at[j], strength[j]
            if kind >= SENTENCE:
                break
        if cut is None:
            target = start + (left + (least - 1) * overlap) / least
            a, b = bisect_right(at, max(end, start + overlap)), bisect_right(at, min(start + limit, n - 1))
            if a < b:
                j = max(range(a, b), key=lambda x: (strength[x], -abs(at[x] - target)))  # noqa: B023
                cut, kind = at[j], strength[j]
        if cut is None and (b := bisect_right(at, start + limit)) > (a := bisect_right(at, end)):
            # Only boundaries within what pieces share: a short piece, and nothing shared with the next.
            out.append((start, at[b - 1], strength[b - 1]))
            start = end = at[b - 1]
            continue
        if cut is None:  # the next boundary, sharing less with the piece before
            j = bisect_right(begin, end)
            stop = at[j] if j < len(at) and at[j] - end <= limit and at[j] < n else begin[j] if j < len(at) else n
            if stop - end <= limit:
                start = max(start, stop - limit)
                if stop >= n:
                    break
                cut, kind = stop, strength[j] if stop == at[j] else TOKEN
            else:
                cut = min(start + limit, end + math.ceil((stop - end) / math.ceil((stop - end) / (limit - overlap))))
        out.append((start, cut, kind))
        end, start = cut, max(cut - overlap, start + 1)
    out.append((start, n, PARAGRAPH))
    return out


def split_claims(sizes: list[int], limit: int = CLAIM_LIMIT) -> list[tuple[int, int]]:
    """``(first, last)`` runs of claims of at most ``limit`` characters in sum, of about equal sums;
    neighbours share one claim where it fits. A claim over the limit is a run of its own."""
    n, total = len(sizes), sum(sizes)
    if not n:
        return []
    pieces = max(1, math.ceil(total / limit))
    out: list[tuple[int, int]] = []
    i, done = 0, 0
    while i < n:
        shared = i - 1 if i and sizes[i - 1] + sizes[i] <= limit and out and out[-1][0] != i - 1 else i
        size, j = sum(sizes[shared : i + 1]), i
        left = max(1, pieces - len(out))
        target = done + (total - done) / left
        while j + 1 < n and size + sizes[j + 1] <= limit and done + sum(sizes[i : j + 2]) <= target + sizes[j + 1] / 2:
            j += 1
            size += sizes[j]
        out.append((shared, j))
        done += sum(sizes[i : j + 1])
        i = j + 1
    return out


_KIND = pa.list_(pa.struct([(c, pa.int32()) for c in ("piece_no", "start", "end", "first_claim", "last_claim", "boundary")]))


def _split_texts(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                rows.append([{"piece_no": k, "start": a, "end": b, "first_claim": None, "last_claim": None, "boundary": s} for k, (a, b, s) in enumerate(split_text(text, limit, overlap))])
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(rows, _KIND)], ["item_id", "pieces"])

    return run


def _split_claim_rows(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for quotes in batch.column("quotes").to_pylist():
                sizes, pieces = [len(q or "") for q in quotes], []
                for a, b in split_claims(sizes, limit):
                    cuts = split_text(quotes[a], limit, overlap) if a == b and sizes[a] > limit else [(0, sizes[b], PARAGRAPH)]
                    pieces += [{"piece_no": len(pieces) + k, "start": s, "end": e, "first_claim": a, "last_claim": b, "boundary": g} for k, (s, e, g) in enumerate(cuts)]
                rows.append(pieces)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(rows, _KIND)], ["item_id", "pieces"])

    return run


def split_pages(pages: DataFrame, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> DataFrame:
    """``item_id, pieces`` of each ``markdown`` over ``limit`` characters. Shorter, empty and null texts
    give no row; repeated rows give one each. Offsets count code points; in text pieces the claim
    columns are null. A piece whose ``boundary`` is 0 ends within a word."""
    big = pages.where(F.length("markdown") > limit).select(F.col("fetch_id").alias("item_id"), F.col("markdown").alias("text"))
    return big.mapInArrow(_split_texts(limit, overlap), f"item_id bigint, pieces {PIECES}")


def split_claim_lists(chunks: DataFrame, limit: int = CLAIM_LIMIT, overlap: int = TEXT_OVERLAP) -> DataFrame:
    """``item_id, pieces`` of each row whose quotes have over ``limit`` characters in sum. A null quote
    counts as empty; null and empty ``claims`` give no row. ``first_claim``/``last_claim`` are positions
    from 0; ``start``/``end`` lie in the claim where a single one is cut, its pieces sharing ``overlap``
    characters, else they span the last claim."""
    rows = chunks.where("claims is not null").select(F.col("chunk_id").alias("item_id"), F.col("claims.quote").alias("quotes"))
    big = rows.where(F.aggregate("quotes", F.lit(0), lambda s, q: s + F.coalesce(F.length(q), F.lit(0))) > limit)
    return big.mapInArrow(_split_claim_rows(limit, overlap), f"item_id bigint, pieces {PIECES}")


def item_pieces(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``item_kind, item_id, pieces`` of each item that had to be cut."""
    a = split_pages(pages).select(F.lit("fetch").alias("item_kind"), "item_id", "pieces")
    return a.unionByName(split_claim_lists(chunks).select(F.lit("claims").alias("item_kind"), "item_id", "pieces"))


def oversized_items(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``item_kind, item_id, forced`` of each item that had to be cut into pieces; ``forced`` is 1 where
    one of its pieces ends within a word."""
    forced = F.exists("pieces", lambda p: p["boundary"] == FORCED)
    return item_pieces(pages, chunks).select("item_kind", "item_id", forced.cast("bigint").alias("forced")).distinct()
