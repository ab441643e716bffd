"""Problem 8: filling containers of fixed capacity with texts."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import spread, written

CAPACITY = 2048
TOKENIZER = os.environ.get("SIEVEWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# How the public tokenizer parts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of one shard; islands of a shard, individuals of an island, epochs between which elites move, generations of an epoch.
SHARD, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 1000, 3, 4, 4, 12
#: Containers filled less than this after the first round give their items to the second.
WELL_FILLED = 0.985


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    """The byte-level BPE tokenizer of a vocabulary file of base64 words and ranks. A worker that has
    no such file reads the copy that Spark gave its executor."""
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _sizes(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


def text_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, tokens`` of each text that has any; of repeated rows of an id the one of fewest tokens.
    The vocabulary file goes to the executors with Spark."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    sizes = spread(rows).mapInArrow(_sizes(tokenizer, pattern), "doc_id bigint, tokens bigint").where("tokens > 0")
    return sizes.groupBy("doc_id").agg(F.min("tokens").alias("tokens"))


# --- grouping genetic algorithm -----------------------------------------------------------------


def _best_fit(bins: list[list[int]], space: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Puts items, largest first, each into the bin it leaves least room in; opens bins as needed."""
    room = sorted((s, k) for k, s in enumerate(space) if s > 0)
    for i in items:
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            s, k = room.pop(at)
        else:
            s, k = capacity, len(bins)
            bins.append([])
            space.append(capacity)
        bins[k].append(i)
        space[k] = s - size[i]
        if space[k] > 0:
            insort(room, (space[k], k))


def _fitness(space: list[int], capacity: int) -> tuple[int, float]:
    """Few bins, and those well filled (mean squared fill)."""
    return -len(space), sum(((capacity - s) / capacity) ** 2 for s in space) / max(len(space), 1)


def _exchange(bins: list[list[int]], space: list[int], free: list[int], size: list[int], rng) -> list[int]:
    """Fills bins up from the free items: one or two items of a bin change places with one or two free
    ones that fill it better, as long as that helps. Returns the items that are free then, which are
    smaller and easier to place."""
    have = sorted((size[i], i) for i in free)
    end = 1 << 60
    for k in rng.permutation(len(bins)).tolist():
        x, s = bins[k], space[k]
        while s and have:
            at = bisect_right(have, (s, end)) - 1
            gain, out, into = (have[at][0], (), (at,)) if at >= 0 else (0, (), ())
            leave = [(size[i], (p,)) for p, i in enumerate(x)]
            leave += [(size[x[p]] + size[x[q]], (p, q)) for p in range(len(x)) for q in range(p)]
            for w, ps in leave:
                at = bisect_right(have, (w + s, end)) - 1
                if at >= 0 and have[at][0] - w > gain:
                    gain, out, into = have[at][0] - w, ps, (at,)
            if gain < s:
                for w, ps in leave:
                    low, high = 0, len(have) - 1
                    while low < high:
                        t = have[low][0] + have[high][0] - w
                        if t > s:
                            high -= 1
                        else:
                            if t > gain:
                                gain, out, into = t, ps, (low, high)
                            low += 1
                    if gain == s:
                        break
            if not gain:
                break
            new = [have[a] for a in into]
            for a in sorted(into, reverse=True):
                have.pop(a)
            for p in sorted(out, reverse=True):
                i = x.pop(p)
                insort(have, (size[i], i))
            x.extend(i for _, i in new)
            s -= gain
        space[k] = s
    return [i for _, i in reversed(have)]


def _settle(bins: list[list[int]], space: list[int], free: list[int], size: list[int], capacity: int, rng) -> tuple:
    free = _exchange(bins, space, free, size, rng)
    free.sort(key=lambda i: -size[i])
    _best_fit(bins, space, free, size, capacity)
    return bins, space


def _cross(a: tuple, b: tuple, size: list[int], capacity: int, rng) -> tuple:
    """Injects whole well-filled bins of ``b`` into ``a``, drops the bins of ``a`` that hold any of
    their items, and places the displaced ones."""
    bins_b, space_b = b
    order = np.argsort(space_b, kind="stable")[: max(1, len(bins_b) * 2 // 3)]
    take = order[rng.random(len(order)) < rng.uniform(0.2, 0.6)]
    given = [bins_b[k] for k in take] or [bins_b[int(order[0])]]
    inside = {i for x in given for i in x}
    bins, space, free = [list(x) for x in given], [capacity - sum(size[i] for i in x) for x in given], []
    for x, s in zip(*a):
        if inside.isdisjoint(x):
            bins.append(list(x))
            space.append(s)
        else:
            free += [i for i in x if i not in inside]
    return _settle(bins, space, free, size, capacity, rng)


def _mutate(a: tuple, size: list[int], capacity: int, rng) -> tuple:
    """Empties the worst bins and a few others, and places their items anew."""
    bins, space = a
    n = len(bins)
    gone = set(np.argsort(space, kind="stable")[-max(2, n // 50) :].tolist()) | set(rng.integers(0, n, max(1, n * 8 // 100)).tolist())
    free = [i for k in sorted(gone) for i in bins[k]]
    kept = [k for k in range(n) if k not in gone]
    return _settle([list(bins[k]) for k in kept], [space[k] for k in kept], free, size, capacity, rng)


def best_fit(size: list[int], capacity: int = CAPACITY, shake: float = 1.0, rng=None) -> tuple[list[list[int]], list[int]]:
    """Bins by best fit, largest items first; with ``shake`` below 1 in an order that is somewhat random."""
    order = sorted(range(len(size)), key=lambda i: (-size[i] * (rng.uniform(shake, 1.0) if rng is not None else 1), i))
    bins: list[list[int]] = []
    space: list[int] = []
    _best_fit(bins, space, order, size, capacity)
    return bins, space


def fewest(size: list[int], capacity: int = CAPACITY) -> int:
    """A lower bound of the number of bins: by the sum, and for each least size by the items too large
    to share a bin with it."""
    s = np.sort(np.asarray(size, np.int64))[::-1]
    least = -(-int(s.sum()) // capacity)
    large = s[s > capacity // 2]
    for a in np.unique(s[s <= capacity // 2]):
        pair = large[large <= capacity - a]
        rest = int(s[(s <= capacity // 2) & (s >= a)].sum()) - (len(pair) * capacity - int(pair.sum()))
        least = max(least, len(large) + max(0, -(-rest // capacity)))
    return least


def first_people(size: list[int], capacity: int, seed: int, population: int = POPULATION) -> list[tuple]:
    """The first individuals of an island: best fit, and best fit in shaken orders."""
    rng = np.random.default_rng(seed)
    return [best_fit(size, capacity), *(best_fit(size, capacity, 0.85, rng) for _ in range(population - 1))]


def evolve(people: list[tuple], size: list[int], capacity: int, seed: int, generations: int = GENERATIONS, least: int = 0) -> list[tuple]:
    """One epoch of an island; ends early at ``least`` bins. The same input and seed give the same."""
    rng = np.random.default_rng(seed)
    score = lambda x: _fitness(x[1], capacity)
    people = sorted(people, key=score, reverse=True)
    for _ in range(generations):
        if len(people[0][0]) <= least:
            break
        other = people[int(rng.integers(1, len(people)))] if len(people) > 1 else people[0]
        child = _cross(other, people[0], size, capacity, rng) if rng.random() < 0.5 else _mutate(people[0], size, capacity, rng)
        if score(child) > score(people[-1]):
            people[-1] = child
            people.sort(key=score, reverse=True)
    return people


def pack(size: list[int], capacity: int = CAPACITY, seed: int = 0, islands: int = ISLANDS, epochs: int = EPOCHS) -> list[list[int]]:
    """Bins of item numbers, the whole algorithm in one process: what :func:`containers` does for a shard
    with a task for each island. No item may exceed ``capacity``."""
    if not size:
        return []
    least = fewest(size, capacity)
    worlds = [first_people(size, capacity, seed * 1000 + k) for k in range(islands)]
    score = lambda x: _fitness(x[1], capacity)
    for number in range(epochs):
        if any(-score(x)[0] <= least for world in worlds for x in world):
            break
        elites = [max(world, key=score) for world in worlds]
        for k, world in enumerate(worlds):
            world[world.index(min(world, key=score))] = elites[k - 1]
        worlds = [evolve(world, size, capacity, seed * 1000 + k * 31 + number, least=least) for k, world in enumerate(worlds)]
    return max((x for world in worlds for x in world), key=score)[0]


def _numbers(person: tuple, n: int) -> list[int]:
    out = [0] * n
    for k, x in enumerate(person[0]):
        for i in x:
            out[i] = k
    return out


def _person(numbers: list[int], size: list[int], capacity: int) -> tuple:
    bins: list[list[int]] = [[] for _ in range(max(numbers) + 1)]
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return bins, [capacity - sum(size[i] for i in x) for x in bins]


_STATE = "shard bigint, island int, size array<int>, people array<array<int>>, bins int, fill double, least int"


def _epoch(capacity: int, number: int, salt: int):
    """shard, island, size, people, guest -> one epoch on; without people the first ones are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("people", "bins", "fill", "least")}
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "island", "size", "people", "guest", "least")))
            for shard, island, size, people, guest, least in rows:
                seed = abs(hash((shard, island, number, salt))) % (1 << 63)
                if people is None:
                    least, now = fewest(size, capacity), first_people(size, capacity, seed)
                else:
                    now = [_person(p, size, capacity) for p in people]
                    if guest is not None:  # the elite of the island before takes the weakest place
                        now[-1] = _person(guest, size, capacity)
                    now = evolve(now, size, capacity, seed, least=least)
                now = sorted(now, key=lambda x: _fitness(x[1], capacity), reverse=True)
                out["people"].append([_numbers(p, len(size)) for p in now])
                out["bins"].append(len(now[0][0]))
                out["fill"].append(_fitness(now[0][1], capacity)[1])
                out["least"].append(least)
            cols = [batch.column("shard"), batch.column("island"), batch.column("size"), pa.array(out["people"], pa.list_(pa.list_(pa.int32()))), pa.array(out["bins"], pa.int32()), pa.array(out["fill"], pa.float64()), pa.array(out["least"], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "island", "size", "people", "bins", "fill", "least"])

    return run


def _packed(items: DataFrame, shards: int, capacity: int, salt: int) -> DataFrame:
    """``shard, bin, fill, doc_id, token_start, token_end``: items in bins by the grouping genetic
    algorithm. Each island of a shard is a row and evolves in a task of its own; between epochs the
    elite of each island moves to the next one by a join. Shards whose best individual has the least
    number of bins possible are done and take no further part."""
    rows = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "token_start", F.lit(salt)), F.lit(shards)).cast("bigint"))
    packs = written(rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("doc_id", "token_start", "token_end"))).alias("items")), "shards")
    size = F.expr("transform(items, x -> int(x.token_end - x.token_start))")
    islands = shards * ISLANDS
    tasks = max(min(islands, 4 * items.sparkSession.sparkContext.defaultParallelism), islands // 500)
    spread_out = lambda df: df.repartition(tasks, "shard", "island")
    empty = packs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), size.alias("size"), F.lit(None).cast("array<array<int>>").alias("people"), F.lit(None).cast("array<int>").alias("guest"), F.lit(None).cast("int").alias("least"))
    state = written(spread_out(empty).mapInArrow(_epoch(capacity, 0, salt), _STATE), "islands")
    done = None
    for number in range(1, EPOCHS + 1):
        best = state.groupBy("shard").agg(F.min("bins").alias("b"), F.max("least").alias("l"))
        finished = state.join(best.where("b <= l").select("shard"), "shard", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        open_ = state.join(best.where("b > l").select("shard"), "shard", "left_semi")
        if open_.isEmpty():
            state = None
            break
        guests = open_.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("people")[0].alias("guest"))
        state = written(spread_out(open_.join(guests, ["shard", "island"])).mapInArrow(_epoch(capacity, number, salt), _STATE), "islands")
    every = done if state is None else state if done is None else done.unionByName(state)
    top = every.groupBy("shard").agg(F.max_by(F.col("people")[0], F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("bin"))
    placed = packs.join(top, "shard").select("shard", F.explode(F.arrays_zip("items", "bin")).alias("x")).select("shard", F.col("x.bin").alias("bin"), "x.items.doc_id", "x.items.token_start", "x.items.token_end")
    fill = placed.groupBy("shard", "bin").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("fill"))
    return written(placed.join(fill, ["shard", "bin"]), "packed")


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, token_start, token_end, container, place, fill``: which tokens of each text stand
    where. A text is split only when it exceeds the capacity: into full containers and a rest.

    Items are spread over shards of about ``SHARD`` by a hash, so no group of texts is packed in one
    task; containers that stay less than ``WELL_FILLED`` full hand their items on to a second round
    over new shards. Null and empty texts give no row; equal texts are packed one by one; of repeated
    rows of one ``doc_id`` the one of fewest tokens counts.
    """
    sizes = written(text_sizes(documents, tokenizer, pattern), "sizes")
    pieces = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.expr(f"(tokens - 1) div {capacity}"))).alias("k"))
    pieces = pieces.select("doc_id", (F.col("k") * capacity).alias("token_start"), F.least(F.col("tokens"), (F.col("k") + 1) * capacity).alias("token_end"))
    full = pieces.where(F.col("token_end") - F.col("token_start") == capacity)
    rest = pieces.where(F.col("token_end") - F.col("token_start") < capacity)
    key = lambda df, r: df.select("doc_id", "token_start", "token_end", "fill", (F.shiftleft("shard", 22) + F.col("bin") * 4 + r).alias("container"))
    first = _packed(rest, max(1, round(rest.count() / SHARD)), capacity, 1)
    poor = first.where(F.col("fill") < WELL_FILLED * capacity).select("doc_id", "token_start", "token_end")
    again = _packed(poor, max(1, round(poor.count() / SHARD)), capacity, 2)
    numbered = key(first.where(F.col("fill") >= WELL_FILLED * capacity), 1).unionByName(key(again, 2))
    # Places in a container: at most as many rows as its capacity.
    inside = numbered.groupBy("container").agg(F.max("fill").alias("fill"), F.array_sort(F.collect_list(F.struct("doc_id", "token_start", "token_end"))).alias("items"))
    placed = inside.select("container", "fill", F.posexplode("items").alias("place", "x")).select("x.doc_id", "x.token_start", "x.token_end", "container", F.col("place").cast("bigint").alias("place"), "fill")
    # A full piece is a container of its own; numbers by partition and row cannot meet, and are written so that they stay.
    alone = written(full.select("doc_id", "token_start", "token_end", (F.monotonically_increasing_id() * 4).alias("container")), "full")
    return placed.unionByName(alone.select("doc_id", "token_start", "token_end", "container", F.lit(0).cast("bigint").alias("place"), F.lit(capacity).cast("bigint").alias("fill")))
