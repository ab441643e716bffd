"""Problem 9: documents that hold passages of evaluation items."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.words import shingles, word_hashes
from sievework.session import spread

SHINGLE = 5
#: MinHash values of a window. An item of which half stands in a window of twice its size class
#: shares each with a chance of a fifth or more: all are missed once in 30,000 cases.
VALUES = 48
#: Exact containment of an item's shingles in the document from which a pair is looked at word by
#: word, and the share of the item's words that must then stand in order.
CONTAINMENT, ORDERED = 0.25, 0.5
#: A matched run of fewer words does not count as part of a piece.
LEAST_RUN = 4
#: Items are matched in blocks of so many, the bound of what a task holds of them at once.
ITEM_BLOCK = 20_000

_MULTIPLIERS = (np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def size_classes(sizes: list[int]) -> list[int]:
    """Upper bounds of the size partitions: each a quarter larger than the one before."""
    out, bound = [], 16
    top = max(sizes, default=0)
    while True:
        if any((out[-1] if out else 0) < s <= bound for s in sizes):
            out.append(bound)
        if bound >= top:
            return out
        bound = -(-bound * 5 // 4)


class ItemIndex:
    """MinHash values of the items, by size class, and their shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        words, at = word_hashes([t for _, t in items])
        self.ids, self.words, self.shingles = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # words of an item under SHINGLE: hash of all of them, ids
        for (item_id, _), a, b in zip(items, at[:-1], at[1:]):
            if 0 < b - a < SHINGLE:
                self.short.setdefault(int(b - a), {}).setdefault(int(shingles(words[a:b], int(b - a))[0]), []).append(item_id)
            elif b > a:
                self.ids.append(item_id)
                self.words.append(words[a:b])
                self.shingles.append(np.unique(shingles(words[a:b], SHINGLE)))
        self.classes = size_classes([len(w) for w in self.words])
        self.tables = []  # per class and value: sorted minima and the items they belong to
        lower = 0
        for bound in self.classes:
            own = [i for i, w in enumerate(self.words) if lower < len(w) <= bound]
            lower = bound
            per_value = []
            for m in _MULTIPLIERS:
                low = np.array([(self.shingles[i] * m).min() for i in own], np.uint64)
                order = np.argsort(low, kind="stable")
                per_value.append((low[order], np.array(own)[order]))
            self.tables.append(per_value)

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a MinHash value in some window. ``hashes`` are the shingles
        of all texts, ``at`` where each text begins; texts without shingles are empty ranges."""
        out: set[tuple[int, int]] = set()
        counts = np.diff(at)
        for bound, per_value in zip(self.classes, self.tables):
            blocks = -(-counts // bound)
            owner = np.repeat(np.arange(len(counts)), blocks)
            if not len(owner):
                continue
            first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
            starts = at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * bound
            joins = np.flatnonzero(owner[1:] == owner[:-1])  # a window is a block and the next one
            for m, (low, own) in zip(_MULTIPLIERS, per_value):
                if not len(low):
                    continue
                least = np.minimum.reduceat(hashes * m, starts)
                least[joins] = np.minimum(least[joins], least[joins + 1])
                pos = np.searchsorted(low, least)
                pos[pos == len(low)] = 0
                for w in np.flatnonzero(low[pos] == least):
                    k = pos[w]
                    while k < len(low) and low[k] == least[w]:
                        out.add((int(owner[w]), int(own[k])))
                        k += 1
        return out

    def short_items(self, words: np.ndarray) -> list[int]:
        """Items of fewer words than a shingle that a text (its words) holds whole."""
        out = []
        for n, table in self.short.items():
            if len(words) >= n:
                own = np.unique(shingles(words, n))
                for h, ids in table.items():
                    k = int(np.searchsorted(own, np.uint64(h)))
                    if k < len(own) and int(own[k]) == h:
                        out += ids
        return out

    def holds(self, item: int, words: np.ndarray, own: np.ndarray) -> bool:
        """Whether a text (its words and their shingles) holds the item, whole or in part."""
        mine = self.shingles[item]
        hit = np.isin(own, mine)
        if len(np.unique(own[hit])) < CONTAINMENT * len(mine):
            return False
        where = np.flatnonzero(hit)
        target = self.words[item]
        need, reach = ORDERED * len(target), 2 * len(target)
        # Hits further apart than twice the item belong to different passages.
        cuts = np.flatnonzero(np.diff(where) > reach) + 1
        for group in np.split(where, cuts):
            a, b = max(0, int(group[0]) - len(target)), min(len(words), int(group[-1]) + SHINGLE + len(target))
            blocks = SequenceMatcher(None, target.tolist(), words[a:b].tolist(), autojunk=False).get_matching_blocks()
            if sum(x.size for x in blocks if x.size >= LEAST_RUN) >= need:
                return True
        return False


def _search(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                ids = batch.column("doc_id").to_pylist()
                words, at = word_hashes(batch.column("text").to_pylist())
                every = shingles(words, SHINGLE)
                # Shingles that run over a text's end are left out.
                keep = np.ones(len(every), bool)
                for e in at[1:-1]:
                    keep[max(0, e - SHINGLE + 1) : e] = False
                counts = np.maximum(np.diff(at) - SHINGLE + 1, 0)
                hashes = every[keep[: len(every)]]
                begins = np.concatenate(([0], np.cumsum(counts)))
                docs, items = [], []
                if index.short:
                    for d in range(len(ids)):
                        for item_id in index.short_items(words[at[d] : at[d + 1]]):
                            docs.append(ids[d])
                            items.append(item_id)
                if len(hashes):
                    for d, i in sorted(index.candidates(hashes, begins)):
                        if index.holds(i, words[at[d] : at[d + 1]], hashes[begins[d] : begins[d + 1]]):
                            docs.append(ids[d])
                            items.append(index.ids[i])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], ["doc_id", "item_id"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: documents that hold at least half the words of an item in order, in one
    piece or a few, small changes aside.

    The items are the stated query set: the driver reads them in blocks of ``ITEM_BLOCK`` and each
    block goes over all documents. Short items are found inside long documents by MinHash over
    windows of their size class; candidates are verified by exact shingle containment and then word
    by word in order. An item of fewer than five words must stand whole. In scripts without spaces each
    character is a word. Null and empty texts, and items without a word, are in no pair; repeated rows
    of an id give one.
    """
    rows = items.where("item_id is not null and item_text is not null").select("item_id", "item_text").distinct().orderBy("item_id")
    docs = spread(documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text"))
    found, block = None, []

    def search(block: list[tuple[int, str]]) -> DataFrame:
        return docs.mapInArrow(_search(ItemIndex(block)), "doc_id bigint, item_id bigint")

    for row in rows.toLocalIterator():
        block.append((row.item_id, row.item_text))
        if len(block) == ITEM_BLOCK:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    return found.distinct()
