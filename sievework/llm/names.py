"""Problem 4: variant spellings of people and institutions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.components import connected_components
from sievework.llm.cosine_join import cosine_pairs, ngram_vectors
from sievework.llm.name_groups import GROUP, close_spellings, gram_counts, grouped, key_blocks, met_profiles, split_groups
from sievework.session import dropped, spread, written

ORG_COSINE, PERSON_COSINE = 0.3, 0.5
#: Average similarity at which average-linkage clustering stops; a link that passed the check of the
#: words counts from a half up, members without a link count 0.
LINKAGE = 0.25
#: Components of up to so many members are clustered in one task, larger ones by rounds over all tasks,
#: with the same result.
LINKAGE_SIZE = 1500

# How words of institution names are written, and letters of other scripts.
_WORDS = {
    "univ": "university", "u": "university", "université": "university", "universite": "university", "universität": "university", "universitat": "university",
    "universidad": "university", "universita": "university", "università": "university", "uni": "university",
    "inst": "institute", "institut": "institute", "instituto": "institute", "tech": "technology", "technol": "technology", "tecnologia": "technology", "technologie": "technology",
    "natl": "national", "nat": "national", "nationale": "national", "nacional": "national", "nat'l": "national",
    "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "laboratoire": "laboratory", "laboratorio": "laboratory", "labor": "laboratory",
    "acad": "academy", "académie": "academy", "academie": "academy", "akademie": "academy", "academia": "academy", "sci": "science", "sciences": "science", "wissenschaften": "science", "ciencias": "science",
    "hosp": "hospital", "hôpital": "hospital", "hopital": "hospital", "krankenhaus": "hospital", "children": "child", "childrens": "child", "children's": "child", "enfants": "child", "kinder": "child",
    "dept": "department", "dep": "department", "département": "department", "departamento": "department", "coll": "college", "ctr": "center", "centre": "center", "centro": "center",
}
_DROPPED = frozenset("of the for de la le du des der die das für fur del y et und and at in ltd limited inc llc gmbh co corp company plc sa ag s".split())
_KINDS = frozenset("university institute technology national laboratory academy science hospital child analytics college center school clinic company department group faculty museum library agency council".split())
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i y k l m n o p r s t u f h ts ch sh shch  y  e yu ya".split(" ")))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψως", "a v g d e z i th i k l m n x o p r s t y f ch ps o s".split(" ")))
_TITLES = frozenset("dr prof professor phd md msc bsc mr mrs ms miss sir dame jr sr ing dipl habil rer nat hc doctor prof. dr.".split())


def latin(text: str) -> str:
    """Lower case without accents, Cyrillic and Greek letters written in Latin ones."""
    low = unicodedata.normalize("NFKC", text).lower()
    low = "".join(_CYRILLIC.get(c, _GREEK.get(c, c)) for c in low)
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)).replace("ß", "ss").replace("ł", "l").replace("ø", "o").replace("đ", "d")


def org_parts(raw: str) -> tuple[str, str]:
    """(words of the institution's kind, words of its place or name), each sorted; a department,
    group or faculty named before or after a comma is left out."""
    s = re.sub(r"\s+", " ", raw.strip().lower().replace("’", "'"))
    pieces = [p.strip() for p in s.split(",")]
    whole = [p for p in pieces if not re.match(r"(?:dept|dep|department|département|faculty|school|division|section|chair|group)\b", p) and not re.search(r"\b(?:group|division|section|unit|department)$", p)]
    s = " ".join(whole or pieces)
    m = re.match(r"^([a-z]{2,5})\s*\(([^)]+)\)$", s)
    if m and latin(m.group(2))[:1] in m.group(1):  # initials of the whole name, before the place in brackets
        return "#" + m.group(1).replace(latin(m.group(2))[:1], "", 1), latin(m.group(2))
    words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", s)
    words = [_WORDS.get(w, w) for w in words]
    words = [latin(_WORDS.get(w.split("'")[0] if "'" in w and w not in _WORDS else w, w).split("'")[0]) for w in words]
    words = [_WORDS.get(w, w) for w in words]
    kind = sorted({w for w in words if w in _KINDS and w not in ("department", "group", "faculty")})
    rest = sorted({w for w in words if w not in _KINDS and w not in _DROPPED and len(w) > 1})
    return " ".join(kind), " ".join(rest)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, ``most + 1`` when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def near_word(a: str, b: str) -> bool:
    """Equal up to typing: one edit in short words, two from eight letters on."""
    if a == b:
        return True
    n = min(len(a), len(b))
    return n >= 4 and edits(a, b, 2 if n >= 8 else 1) <= (2 if n >= 8 else 1)


def person_tokens(name: str) -> list[str]:
    """Words of a name without titles; initials are single letters."""
    s = latin(name)
    return [w for w in re.findall(r"[^\W\d_]+", s.replace("'", "")) if w not in _TITLES]


@lru_cache(maxsize=1 << 16)
def _phonetic(w: str) -> str:
    """One way of writing sounds that transliteration writes in several."""
    for a, b in (("qu", "ku"), ("sch", "sh"), ("sh", "s"), ("skh", "s"), ("ch", "h"), ("kh", "h"), ("th", "t"), ("zh", "z"), ("ts", "c"), ("c", "k"), ("w", "v"), ("ph", "f"), ("x", "ks"), ("h", ""), ("y", "i")):
        w = w.replace(a, b)
    return w


def _given_match(a: str, b: str) -> bool:
    if a == b or a[0] == b[0] and (len(a) == 1 or len(b) == 1):
        return True
    if near_word(a, b) or _phonetic(a) == _phonetic(b):
        return True
    # A short form: the first letters of the name, then an ending of one or two vowels.
    for x, y in ((a, b), (b, a)):
        stem = re.sub(r"(?:ie|y|i|o|ey|ee|a)$", "", x)
        if 2 <= len(stem) < len(y) and stem != x and y.startswith(stem) and len(x) <= len(y) + 1:
            return True
    return False


def same_name(a: list[str], b: list[str]) -> bool:
    """Whether two names can be one: one word of four letters or more is shared up to typing, and
    the remaining words can be paired (equal, mistyped, short forms or initials); a middle name or
    initial may be absent."""
    long_a, long_b = [w for w in a if len(w) > 3], [w for w in b if len(w) > 3]
    for x in long_a:
        for y in long_b:
            if x == y or near_word(x, y) or (_phonetic(x) == _phonetic(y)) or (len(x) > 6 and edits(_phonetic(x), _phonetic(y), 1) <= 1):
                ra, rb = list(a), list(b)
                ra.remove(x)
                rb.remove(y)
                if not ra or not rb:
                    continue
                if len(ra) > len(rb):
                    ra, rb = rb, ra
                # The first remaining words must fit; further ones only where both have them.
                main_a = [w for w in ra if len(w) > 1] or ra
                main_b = [w for w in rb if len(w) > 1] or rb
                if any(_given_match(p, q) for p in main_a[:1] for q in (main_b[:1] if len(main_b[0]) > 1 else rb)) or (len(ra[0]) == 1 and any(q[0] == ra[0] for q in rb[:1])):
                    return True
    return False


def close_name(a: list[str], b: list[str]) -> bool:
    """As ``same_name``, where no context speaks for it: every word of the shorter name is one of the
    other up to one edit, an initial, or a short form."""
    if not same_name(a, b):
        return False

    def fits(x: str, y: str) -> bool:
        if x[0] == y[0] and 1 in (len(x), len(y)):
            return True
        short, long = sorted((x, y), key=len)
        stem = re.sub(r"(?:ie|y|i|o|ey|ee|a)$", "", short)
        return edits(_phonetic(x), _phonetic(y), 1) <= 1 or 2 <= len(stem) < len(short) and long.startswith(stem)

    a, b = sorted((a, b), key=len)
    return all(any(fits(x, y) for y in b) for x in a)


def _person_text(words: list[str]) -> str:
    return " ".join(sorted(_phonetic(w) or w for w in words if len(w) > 1)) or " ".join(words)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """raw -> raw, text (what the n-grams are taken of), key (for the exact check)."""
    for batch in batches:
        text, key = [], []
        for raw in batch.column("raw").to_pylist():
            k, rest = org_parts(raw)
            text.append(rest + (" " + k if k else ""))
            key.append(k + "|" + rest)
        yield pa.RecordBatch.from_arrays([batch.column("raw"), pa.array(text, pa.string()), pa.array(key, pa.string())], ["raw", "text", "key"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """forms -> keys: the different spellings of a profile, as their words."""
    for batch in batches:
        keys = [list(dict.fromkeys(k for k in (" ".join(person_tokens(raw)) for raw in forms) if k)) for forms in batch.column("forms").to_pylist()]
        rest = [c for c in batch.schema.names if c != "forms"]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.string())), *(batch.column(c) for c in rest)], ["keys", *rest])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key -> text, what the n-grams of a person's spelling are taken of."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_person_text(k.split()) for k in batch.column("key").to_pylist()], pa.string())], ["text"])


def org_match(a: str, b: str) -> bool:
    (ka, ra), (kb, rb) = (x.split("|", 1) for x in (a, b))
    if "#" in ka + kb:
        initials = lambda k: sorted(k[1:] if k[:1] == "#" else (w[0] for w in k.split()))
        return initials(ka) == initials(kb) and bool(ra) and near_word(ra, rb)
    if ka != kb and ka and kb and not (set(ka.split()) <= set(kb.split()) or set(kb.split()) <= set(ka.split())):
        return False
    if ka != kb and (not ka or not kb):
        return False
    if ka != kb and len(set(ka.split()) ^ set(kb.split())) > 1:
        return False
    return bool(ra) and near_word(ra, rb)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [org_match(a, b) for a, b in zip(batch.column("key_a").to_pylist(), batch.column("key_b").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def spelling_links(spellings: DataFrame, least: float = ORG_COSINE) -> tuple[DataFrame, DataFrame]:
    """``key_a, key_b, cosine`` of distinct spellings (``raw``) of one institution: sparse cosine join
    over character n-grams of their keys, then the exact check of the words. Spellings whose keys are
    equal are linked with cosine 1."""
    said = spellings.where("raw is not null and trim(raw) <> ''")
    keyed = written(said.select("raw").distinct().mapInArrow(_keyed, "raw string, text string, key string"), "spellings")
    texts = keyed.where("text <> ''").select("text", "key").distinct().withColumn("id", F.xxhash64("text"))
    vectors = written(ngram_vectors(texts.groupBy("id").agg(F.min("text").alias("text"))), "vectors")
    near = cosine_pairs(vectors, least)
    keys = texts.select("id", "key")
    same = keys.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("cosine")).distinct()
    pairs = near.unionByName(same)
    pairs = pairs.join(keys.select(F.col("id").alias("id_a"), F.col("key").alias("key_a")), "id_a").join(keys.select(F.col("id").alias("id_b"), F.col("key").alias("key_b")), "id_b")
    pairs = pairs.where("id_a <> id_b or key_a < key_b").select("key_a", "key_b", "cosine")
    good = pairs.mapInArrow(_checked, "key_a string, key_b string, cosine double")
    equal = keyed.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(1.0).alias("cosine")).distinct()
    return good.unionByName(equal), keyed.select("raw", "key")


def average_linkage(ids: list[int], a: list[int], b: list[int], similarity: list[float], least: float = LINKAGE) -> list[int]:
    """Cluster of each of ``ids`` (sorted), named by its least id, by average linkage over the links
    ``a, b``: pairs of clusters that are each other's best merge in rounds until no average reaches
    ``least``. Best is the greatest average, ties by the least ids of both."""
    label = {x: x for x in ids}
    size = dict.fromkeys(ids, 1)
    near: dict[int, dict[int, float]] = {x: {} for x in ids}
    for x, y, w in zip(a, b, similarity):
        if x != y:
            near[x][y] = near[y][x] = max(near[x].get(y, 0.0), w)
    live = set(ids)
    while live:
        best = {}
        for x in live:
            fits = [(-w / (size[x] * size[y]), min(x, y), max(x, y), y) for y, w in near[x].items()]
            top = min(fits, default=None)
            if top is not None and -top[0] >= least - 1e-12:
                best[x] = top[3]
        pairs = [(x, y) for x, y in best.items() if x < y and best.get(y) == x]
        if not pairs:
            break
        for x, y in pairs:
            for z, w in near.pop(y).items():
                del near[z][y]
                if z != x:
                    near[x][z] = near[z][x] = near[x].get(z, 0.0) + w
            size[x] += size[y]
            label[y] = x
        live = {x for x in best if x in near}
        live |= {z for x, _ in pairs for z in near[x]}
    out = []
    for x in ids:
        while label[x] != x:
            x = label[x]
        out.append(x)
    return out


def _linkage(frame: pd.DataFrame) -> pd.DataFrame:
    ids = sorted({*frame.a, *frame.b})
    return pd.DataFrame({"id": ids, "cluster": average_linkage(ids, frame.a.tolist(), frame.b.tolist(), frame.weight.tolist())})


def linkage_rounds(links: DataFrame, least: float = LINKAGE) -> DataFrame:
    """``id, cluster`` by average linkage over ``a < b, weight`` without taking a component into one
    task: in each round all pairs of clusters that are each other's best merge, and the sums of their
    links are added up. Merging mutual bests in any order gives average linkage's own tree, because a
    merge never brings a third cluster nearer than it was to the nearer of the two."""
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = written(ids.select("id", F.col("id").alias("cluster")), "linkage")
    now = written(links.groupBy("a", "b").agg(F.max("weight").alias("total")), "linkage-links")
    while True:
        sizes = label.groupBy("cluster").agg(F.count("*").alias("n"))
        sized = now.join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
        good = sized.withColumn("w", F.col("total") / (F.col("na") * F.col("nb"))).where(F.col("w") >= least - 1e-12)
        sides = good.select(F.col("a").alias("x"), F.struct(-F.col("w"), "a", "b").alias("k")).unionByName(good.select(F.col("b").alias("x"), F.struct(-F.col("w"), "a", "b").alias("k")))
        best = sides.groupBy("x").agg(F.min("k").alias("k")).select(F.col("k.a").alias("a"), F.col("k.b").alias("b"))
        merged = written(best.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b"), "linkage-merged")
        if merged.isEmpty():
            return label
        into = merged.select(F.col("b").alias("old"), F.col("a").alias("new"))
        last = (label, now)
        label = written(label.join(into, label.cluster == into.old, "left").select("id", F.coalesce("new", "cluster").alias("cluster")), "linkage")
        moved = now.join(into.select(F.col("old").alias("a"), F.col("new").alias("x")), "a", "left").join(into.select(F.col("old").alias("b"), F.col("new").alias("y")), "b", "left")
        moved = moved.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), "total").where("a <> b")
        now = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total").groupBy("a", "b").agg(F.sum("total").alias("total")), "linkage-links")
        dropped(*last, merged)


def linked_clusters(links: DataFrame, size: int = LINKAGE_SIZE) -> DataFrame:
    """``id, cluster`` by average linkage within each connected component of ``a, b, cosine``. A link
    counts half and half of its cosine."""
    links = written(links, "links")
    comp = written(connected_components(links.select("a", "b")), "components")
    weighted = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (0.5 + F.col("cosine") / 2).alias("weight"))
    weighted = weighted.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    rows = written(weighted.join(comp.withColumnRenamed("id", "a"), "a").join(sizes, "component"), "component-links")
    dropped(links)
    # Where every two members are linked and all links are strong there is nothing to split.
    full = rows.groupBy("component").agg(F.count("*").alias("links"), F.max("n").alias("n")).where(F.col("links") * 2 == F.col("n") * (F.col("n") - 1)).select("component")
    whole = comp.join(full, "component", "left_semi").unionByName(comp.join(sizes.where("n = 1"), "component", "left_semi")).select("id", F.col("component").alias("cluster"))
    open_ = rows.join(full, "component", "left_anti")
    small = open_.where(F.col("n") <= size).groupBy("component").applyInPandas(_linkage, "id bigint, cluster bigint")
    large = open_.where(F.col("n") > size).select("a", "b", "weight")
    done = whole.unionByName(small)
    done = written(done if large.isEmpty() else done.unionByName(linkage_rounds(large)), "clusters")
    dropped(comp, rows)
    return done


def org_clusters(names: DataFrame) -> DataFrame:
    """``raw, org``: the institution of each distinct spelling in ``names`` (``raw``)."""
    links, keyed = spelling_links(names)
    numbered = links.select(F.xxhash64("key_a").alias("a"), F.xxhash64("key_b").alias("b"), "cosine")
    clusters = linked_clusters(numbered)
    return keyed.withColumn("id", F.xxhash64("key")).join(clusters, "id").select("raw", F.col("cluster").alias("org"))


def _one_profile_each(profiles: DataFrame) -> DataFrame:
    """One row per id: of repeated rows of an id the first in order. Where ids do not repeat nothing is moved."""
    wanted = ("name", "name_en", "aliases", "institutions", "keywords")
    rows = profiles.where("profile_id is not null").withColumn("profile_id", F.col("profile_id").cast("bigint"))
    n, ids = rows.agg(F.count("*"), F.count_distinct("profile_id")).first()
    if n == ids:
        return rows.select("profile_id", *wanted)
    return rows.groupBy("profile_id").agg(F.min(F.struct(*wanted)).alias("r")).select("profile_id", "r.*")


def person_links(profiles: DataFrame, orgs: DataFrame, size: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, dict[str, int]]]:
    """``a, b, cosine`` (and the profiles' spellings, which profiles name institutions, and in how many
    spellings each n-gram is): profiles of names that can be one and with a context in common, which is an
    institution or a keyword; profiles that both name institutions must share one.

    A profile goes to each of its contexts with all its spellings, and is compared there with those it
    meets; a context of more than ``size`` profiles is split into pairs of parts."""
    base = _one_profile_each(profiles)
    forms = F.filter(F.concat(F.array("name", "name_en"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    words = F.array_distinct(F.transform(F.filter("keywords", lambda w: F.trim(w) != ""), lambda w: F.lower(F.trim(w))))
    told = base.select(forms.alias("forms"), "profile_id", F.filter("institutions", lambda x: F.trim(x) != "").alias("institutions"), words.alias("words"))
    told = written(spread(told).mapInArrow(_spelled, "keys array<string>, profile_id bigint, institutions array<string>, words array<string>"), "spelled")
    with_key = written(told.select("profile_id", F.explode("keys").alias("key")), "forms")
    named = written(told.where(F.size("institutions") > 0).select("profile_id").withColumn("named", F.lit(True)), "named")
    total, counts = gram_counts(with_key.select("key").distinct().mapInArrow(_texts, "text string"))
    within = told.select("profile_id", "keys", F.explode("institutions").alias("raw")).join(orgs, "raw").select(F.xxhash64(F.lit("i"), "org").alias("ctx"), "profile_id", F.lit(3).alias("flags"), "keys")
    about = told.select("profile_id", "keys", F.when(F.size("institutions") > 0, 2).otherwise(0).alias("flags"), F.explode("words").alias("w")).select(F.xxhash64(F.lit("k"), "w").alias("ctx"), "profile_id", "flags", "keys")
    rows = within.unionByName(about).where(F.size("keys") > 0)
    met = grouped(split_groups(rows, size), "ctx").mapInArrow(met_profiles(total, counts, PERSON_COSINE, _person_text, same_name), "a bigint, b bigint, cosine double")
    links = written(met.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "person-links")
    dropped(told)
    return links, with_key, named, (total, counts)


def _joined_singles(clusters: DataFrame, links: DataFrame, unnamed: DataFrame) -> DataFrame:
    """``id, cluster`` where members of ``unnamed`` (no institution, so that they are compared with few
    of a cluster and their average is low) that linkage left alone join the cluster of their best link."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    alone = clusters.join(sizes.where("n = 1"), "cluster", "left_semi").join(unnamed, "id", "left_semi").select("id")
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other"), "cosine").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"), "cosine"))
    reach = both.where("id <> other").join(alone, "id", "left_semi").join(clusters.select(F.col("id").alias("other"), "cluster"), "other")
    reach = reach.join(alone.select(F.col("id").alias("other")), "other", "left_anti")
    goal = reach.groupBy("id", "cluster").agg(F.max("cosine").alias("cosine")).groupBy("id").agg(F.max_by("cluster", F.struct("cosine", -F.col("cluster"))).alias("goal"))
    return clusters.join(goal, "id", "left").select("id", F.coalesce("goal", "cluster").alias("cluster"))


def person_clusters(profiles: DataFrame, orgs: DataFrame) -> DataFrame:
    """``profile_id, person``. A profile without institutions that no keyword links is given to the
    one person of its name, or else of a variant of its name, when there is only one such person."""
    links, with_key, named, weights = person_links(profiles, orgs)
    ids = profiles.where("profile_id is not null").select("profile_id").distinct()
    loops = ids.select(F.col("profile_id").alias("a"), F.col("profile_id").alias("b"), F.lit(1.0).alias("cosine"))
    linked = linked_clusters(links.unionByName(loops))
    clusters = written(_joined_singles(linked, links, ids.join(named, "profile_id", "left_anti").select(F.col("profile_id").alias("id"))), "clusters").withColumnRenamed("id", "profile_id")
    dropped(linked)
    open_ids = ids.join(named.select("profile_id"), "profile_id", "left_anti").join(links.select(F.explode(F.array("a", "b")).alias("profile_id")).distinct(), "profile_id", "left_anti")
    open_ids = written(open_ids, "open")
    full = with_key.where("key rlike '^[^ ]{2,} [^ ]{2,}$'").withColumn("k", F.array_join(F.array_sort(F.split("key", " ")), " ")).select("profile_id", "k").distinct()
    homes = full.join(open_ids, "profile_id", "left_anti").join(clusters, "profile_id").groupBy("k").agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("other"))
    homes = written(homes, "homes")
    alone = full.join(open_ids, "profile_id", "left_semi").join(homes, "k", "left")
    # Without any known person of the name, the open profiles of that name go together.
    least = full.join(open_ids, "profile_id", "left_semi").groupBy("k").agg(F.min("profile_id").alias("least"))
    given = alone.join(least, "k").groupBy("profile_id").agg(
        F.min("cluster").alias("cluster"), F.max("other").alias("other"), F.min("least").alias("least")
    ).select("profile_id", F.when(F.col("cluster") == F.col("other"), F.col("cluster")).when(F.col("cluster").isNull(), F.col("least")).alias("moved"))
    people = written(clusters.join(given, "profile_id", "left").select("profile_id", F.coalesce("moved", "cluster").alias("person")), "given")
    # A profile whose exact name settles nothing looks for the one person of a variant of its name.
    exact = homes.select("k").join(full, "k").select("profile_id").distinct()
    lost = written(open_ids.join(exact, "profile_id", "left_anti"), "lost")
    if lost.isEmpty():
        return people
    return _with_variants(people, lost, with_key, profiles, weights)


def _with_variants(people: DataFrame, lost: DataFrame, with_key: DataFrame, profiles: DataFrame, weights: tuple[int, dict[str, int]]) -> DataFrame:
    """``profile_id, person`` where the people of ``lost`` profiles join the one person whose
    spellings can be theirs, whatever the context; of several, the one that shares a research field.
    Spellings are compared once, however many profiles write them."""
    # Two names that are close share a long word up to one edit, or their text: only spellings that share
    # half of such a word meet in a group, and those with that word with one letter left out are compared.
    sought = with_key.join(lost, "profile_id", "left_semi").select("key", F.lit(1).alias("lost"))
    keys = with_key.select("key", F.lit(0).alias("lost")).unionByName(sought).groupBy("key").agg(F.max("lost").alias("lost"))
    blocks = keys.mapInArrow(key_blocks(_person_text, _phonetic), "block bigint, key string, lost int")
    fits = grouped(blocks, "block").mapInArrow(close_spellings(*weights, PERSON_COSINE, _person_text, _phonetic, close_name), "key_a string, key_b string")
    fits = written(fits.distinct(), "close")
    of_key = written(with_key.join(people, "profile_id").select("key", "person").distinct(), "key-persons")
    own = people.join(lost, "profile_id", "left_semi").select(F.col("person").alias("own")).distinct()
    from_ = own.join(of_key, of_key.person == own.own).select("own", F.col("key").alias("key_a"))
    # A name in full is not known by a person's initials where that person is also written in full.
    in_full = lambda c: ~F.col(c).rlike("(^| )[^ ]( |$)")
    written_out = of_key.where(in_full("key")).select("person").distinct().withColumn("full", F.lit(True))
    found = from_.join(fits, "key_a").join(of_key.withColumnRenamed("key", "key_b"), "key_b").where("own <> person").join(written_out, "person", "left")
    met = written(found.where(~in_full("key_a") | in_full("key_b") | F.col("full").isNull()).select("own", "person").distinct(), "variants")
    fields = F.explode("research_fields") if "research_fields" in profiles.columns else F.lit(None).cast("string")
    topic = profiles.select("profile_id", fields.alias("f")).where("trim(f) <> ''").join(people, "profile_id").select("person", F.lower(F.trim("f")).alias("f")).distinct()
    shared = met.join(topic.withColumnRenamed("person", "own"), "own").join(topic, ["person", "f"]).select("own", "person", F.lit(1).alias("shares")).distinct()
    one = met.join(shared, ["own", "person"], "left").groupBy("own").agg(F.count("*").alias("n"), F.count("shares").alias("m"), F.min("person").alias("only"), F.min(F.when(F.col("shares") == 1, F.col("person"))).alias("best"))
    goal = one.select("own", F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("best")).alias("goal")).where("goal is not null")
    # Two lost people join where each is the other's goal; no chain goes through a lost one.
    goal = written(goal, "goals")
    back = goal.select(F.col("own").alias("goal"), F.col("goal").alias("own"))
    settled = goal.join(own.select(F.col("own").alias("goal")), "goal", "left_anti").select("own", "goal")
    comp = settled.unionByName(goal.join(back, ["own", "goal"], "left_semi").where("own > goal").select("own", "goal")).select(F.col("own").alias("person"), F.col("goal").alias("component"))
    return people.join(comp, "person", "left").select("profile_id", F.coalesce("component", "person").alias("person"))


def pairs_of(members: DataFrame, kind: str) -> DataFrame:
    """``entity_kind, id_a, id_b`` of the members (``id, cluster``) of one cluster."""
    a, b = members.select("cluster", F.col("id").alias("id_a")), members.select("cluster", F.col("id").alias("id_b"))
    return a.join(b, "cluster").where("id_a < id_b").select(F.lit(kind).alias("entity_kind"), "id_a", "id_b")


def variant_pairs(profiles: DataFrame, institution_names: DataFrame) -> DataFrame:
    """``entity_kind, id_a, id_b``: profiles of one person, and spellings of one institution.

    Null and empty names, institutions and keywords take no part; a profile with none of them stands
    alone; repeated rows of one id are one; equal rows under other ids are paired.
    """
    spelled = profiles.select(F.explode("institutions").alias("raw")).unionByName(institution_names.select(F.col("raw_name").alias("raw")))
    orgs = written(org_clusters(spelled.distinct()), "orgs")
    org_members = institution_names.where("name_id is not null").select(F.col("name_id").alias("id"), F.col("raw_name").alias("raw")).distinct().join(orgs, "raw").select("id", F.col("org").alias("cluster")).distinct()
    people = written(person_clusters(profiles, orgs), "people").select(F.col("profile_id").alias("id"), F.col("person").alias("cluster")).distinct()
    return pairs_of(people, "person").unionByName(pairs_of(org_members, "org"))
