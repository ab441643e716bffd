"""Near duplicates, names, leakage."""

import random

import pytest

from sievework.llm import leakage as L
from sievework.llm import names as N
from sievework.llm.cosine_join import cosine_pairs, ngram_vectors
from sievework.llm.near_duplicates import near_duplicate_pairs
from sievework.llm.web_pages import boilerplate_lines

HIT = "hit_id bigint, url string, k string, id_a bigint"


def words(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(99)}" for _ in range(n)]


def test_pairs_against_brute_force(spark, pages):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = words(g, 150)
        for k, share in enumerate((0, 0, 0.01, 0.03, 0.25)):
            w = [x if rng.random() >= share else "edited" for x in base]
            rows.append((g * 10 + k, f"h{k}.example", "# Title of the story\n\n" + " ".join(w) + "."))
    rows += [(900, "h.example", None), (901, "h.example", " "), (902, "h.example", "# 404\n\nGo back"), (903, "h.example", "# 404\n\nGo back")]
    hits = spark.createDataFrame([(1, "https://a.example/x", "", 1), (2, "http://www.a.example/x/?gclid=1", "", 1), (3, None, "", 1), (4, "https://a.example/y", "", 1)], HIT)
    got = {tuple(r) for r in near_duplicate_pairs(pages(rows), hits).collect()}
    bodies = {i: " ".join(m.split()).lower() for i, _, m in rows if i < 900}
    sets = {i: {b[k : k + 5] for k in range(len(b) - 4)} for i, b in bodies.items()}
    want = {("fetch", a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert got == want | {("hit", 1, 2)}


def test_large_group_of_copies_on_one_site(spark, pages):
    rng = random.Random(3)
    base = [" ".join(words(40 + k, 40)) + "." for k in range(6)]
    rows = []
    for i in range(9):
        paras = list(base)
        if i > 3:  # near copies: one word of one paragraph
            k = rng.randrange(6)
            paras[k] = paras[k].replace(" ", f" edit{i} ", 1)
        rows.append((i, "s.example", "# The one story\n\n" + "\n\n".join(paras)))
    note = "The editors of this site keep a list of what they have corrected, and it is long."
    rows += [(100 + i, "s.example", f"# Story {chr(97 + i) * 3}\n\n" + " ".join(words(200 + i, 120)) + f".\n\n{note}\n\n" + " ".join(words(300 + i, 120)) + ".") for i in range(7)]
    hits = spark.createDataFrame([], HIT)
    got = {tuple(r) for r in near_duplicate_pairs(pages(rows), hits).collect()}
    assert got == {("fetch", a, b) for a in range(9) for b in range(9) if a < b}
    assert {tuple(r) for r in boilerplate_lines(pages(rows)).collect()} == {(100 + i, 4) for i in range(7)}


PROFILE = "profile_id bigint, name string, name_en string, aliases array<string>, institutions array<string>, keywords array<string>, cluster string"


def test_spellings(spark):
    rows = [
        (1, "Anton Baker", None, None, ["University of Lorvomir"], ["tides"], ""),
        (2, "BAKER, Anton", "Anton Baker", ["A. Baker"], ["Univ. of Lorvomir"], None, ""),
        (3, "A. Baker", None, [], ["LORVOMIR UNIVERSITY"], None, ""),
        (4, "Anton Baker", None, [], ["Zelnevol Institute of Technology"], None, ""),
        (5, "Антон Бакер", None, [], ["Dept. of Physics, University of Lorvomir"], None, ""),
        (6, "Anton Bakre", None, [], [], ["Tides "], ""),
        (7, None, None, None, None, None, ""),
        (8, "Bert Baker", None, [], ["University of Lorvomir"], None, ""),
        (8, "Bert Baker", None, [], ["University of Lorvomir"], None, ""),
    ]
    orgs = [(1, "University of Lorvomir"), (2, "Univ. of Lorvomir"), (3, "LORVOMIR UNIVERSITY"), (4, "Zelnevol Institute of Technology"), (5, "ZIT (Zelnevol)"), (6, "Dept. of Physics, University of Lorvomir"), (7, "Lorvomir Institute of Technology"), (8, None), (9, ""), (10, "University of Lorvomri")]
    got = {tuple(r) for r in N.variant_pairs(spark.createDataFrame(rows, PROFILE), spark.createDataFrame(orgs, "name_id bigint, raw_name string")).collect()}
    uni, zit = [1, 2, 3, 6, 10], [4, 5]
    assert {(a, b) for k, a, b in got if k == "org"} == {(a, b) for a in uni for b in uni if a < b} | {(4, 5)} and zit
    assert {(a, b) for k, a, b in got if k == "person"} == {(a, b) for a in (1, 2, 3, 5, 6) for b in (1, 2, 3, 5, 6) if a < b}


def test_variants_without_context(spark):
    rows = [
        (1, "Corlin Veldukador", None, [], ["University of Lorvomir"], ["tides"], ["optics"], ""),
        (2, "Corlin Veldukadro", None, [], [], ["alone"], [], ""),  # typing
        (3, "C. Veldukador", None, None, None, None, None, ""),  # initial
        (4, "Banon Brethom", None, [], ["University of Lorvomir"], ["a"], ["optics"], ""),
        (5, "Banon Brethom", None, [], ["Zelnevol Institute of Technology"], ["b"], ["tides"], ""),
        (6, "Banon K. Brethmo", None, [], [], ["c"], ["Tides"], ""),  # two people: the research field tells
        (7, "B. Brethom", None, [], [], ["d"], [], ""),  # two people, nothing tells
    ]
    schema = PROFILE.replace("cluster", "research_fields array<string>, cluster")
    got = {tuple(r) for r in N.variant_pairs(spark.createDataFrame(rows, schema), spark.createDataFrame([], "name_id bigint, raw_name string")).collect()}
    assert got == {("person", 1, 2), ("person", 1, 3), ("person", 2, 3), ("person", 5, 6)}


def met_by_definition(rows, least=0.5):
    """Profiles with a context in common, each with each: cosine of n-gram vectors over all texts, then the words."""
    import math

    from sievework.llm.name_groups import text_id

    texts = {N._person_text(k.split()) for _, _, _, keys in rows for k in keys}
    grams = {t: {f" {t} "[i : i + 3] for i in range(len(t))} for t in texts}
    w = {g: math.log(1 + len(texts) / sum(g in x for x in grams.values())) for x in grams.values() for g in x}
    norm = {t: math.sqrt(sum(w[g] ** 2 for g in x)) for t, x in grams.items()}
    out = {}
    for c, i, f, ki in rows:
        for d, j, g, kj in rows:
            if c == d and i < j and (f & 1 or not f & g & 2):
                for x in ki:
                    for y in kj:
                        s, t = N._person_text(x.split()), N._person_text(y.split())
                        cosine = 1.0 if s == t else sum(w[q] ** 2 for q in grams[s] & grams[t]) / norm[s] / norm[t]
                        a, b = (x, y) if (x < y if s == t else text_id(s) < text_id(t)) else (y, x)  # the check of the words has a first name
                        if cosine >= least and (x == y or N.same_name(a.split(), b.split())):
                            out[i, j] = max(cosine, out.get((i, j), 0.0))
    return out


def test_profiles_meet_in_groups_as_by_definition(spark):
    import math

    from sievework.llm import name_groups as G

    rng = random.Random(12)
    names = [f"{a} {b}" for a in ("corlin", "banon", "c", "velim") for b in ("veldukador", "veldukadro", "brethom", "brethmo", "lu")]
    rows = [(i % 3, i, 3 if i % 3 == 0 else rng.choice((2, 0)), sorted({rng.choice(names) for _ in range(2)})) for i in range(90)]
    frame = spark.createDataFrame(rows, "ctx bigint, profile_id bigint, flags int, keys array<string>")
    total, counts = G.gram_counts(spark.createDataFrame([(N._person_text(k.split()),) for *_, keys in rows for k in keys], "text string"))
    run = G.met_profiles(total, counts, 0.5, N._person_text, N.same_name)
    want = met_by_definition(rows)
    for size in (G.GROUP, 7):  # whole and split groups
        met = G.grouped(G.split_groups(frame, size), "ctx").mapInArrow(run, "a bigint, b bigint, cosine double").groupBy("a", "b").max("cosine")
        got = {(a, b): c for a, b, c in met.collect()}
        assert got.keys() == want.keys() and len(got) > 100 and all(math.isclose(got[k], want[k]) for k in got)


def test_groups_larger_than_an_arrow_batch_stay_whole():
    import pyarrow as pa

    from sievework.llm.name_groups import whole_groups

    keys = [1, 2, 2, 2, 2, 2, 3, 4, 4]
    for n in range(1, 10):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + n]}, pa.schema([("k", pa.int64())])) for i in range(0, 9, n)]
        tables = [t.column("k").to_pylist() for t in whole_groups(iter(batches), "k")]
        assert sum(tables, []) == keys and len({(i, k) for i, t in enumerate(tables) for k in t}) == 4


def test_words_one_edit_apart_share_a_block():
    from sievework.llm.name_groups import word_blocks

    rng = random.Random(13)
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10)))
        k = rng.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "x" + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]):
            assert not v or set(word_blocks(w)) & set(word_blocks(v)), (w, v)


def test_text_ids_are_those_of_spark(spark):
    from sievework.llm.name_groups import text_id

    texts = ["", "a", "anton baker", "Антон", "x" * 40]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()] == [text_id(t) for t in texts]


def test_written_tables_leave_no_shuffle_files(spark):
    from sievework.session import written

    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    kept = written(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "probe")
    assert not files() - before and kept.count() == 7


def test_dropped_tables_go_at_once(spark):
    import os

    from sievework.session import dropped, written

    kept = written(spark.range(5), "probe")
    folder = kept._written_to.removeprefix("file://")
    assert os.path.isdir(folder)
    dropped(kept, spark.range(1))
    assert not os.path.exists(folder)


def test_no_profiles(spark):
    assert N.variant_pairs(spark.createDataFrame([], PROFILE), spark.createDataFrame([], "name_id bigint, raw_name string")).count() == 0


@pytest.mark.parametrize("a,b,same", [("anton baker", "baker a", True), ("anton baker", "anton b baker", True), ("anton baker", "bert baker", False), ("banon brethom", "banie brethom", True), ("corlinra veldukador", "corlinra magralindor", False)])
def test_same_name(a, b, same):
    assert N.same_name(a.split(), b.split()) is same


@pytest.mark.parametrize("a,b,same", [("fennek cormikador", "fennek yarmikador", False), ("corlin veldukador", "veldukadro corlin", True), ("sori matikador", "sorkara mtikador", True), ("anton baker", "a baker", True)])
def test_close_name(a, b, same):
    assert N.close_name(a.split(), b.split()) is same


def greedy_linkage(ids, links, least):
    """Average linkage as it is defined: always the pair of clusters with the greatest average."""
    clusters = [[x] for x in ids]
    link = lambda p, q: sum(links.get((min(x, y), max(x, y)), 0.0) for x in p for y in q) / (len(p) * len(q))
    while len(clusters) > 1:
        w, _, _, i, j = max((link(p, q), -min(min(p), min(q)), -max(min(p), min(q)), i, j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if i < j)
        if w < least:
            break
        clusters[i] += clusters.pop(j)
    return {x: min(c) for c in clusters for x in c}


def test_linkage_in_tasks_and_in_rounds_against_its_definition(spark):
    rng = random.Random(6)
    for trial in range(30):
        n = rng.randrange(3, 14)
        links = {(a, b): 0.5 + rng.random() / 2 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4}
        want = greedy_linkage(range(n), links, 0.25)
        a, b = [x for x, _ in links], [y for _, y in links]
        assert dict(enumerate(N.average_linkage(list(range(n)), a, b, list(links.values())))) == want
        if trial < 2 and links:
            frame = spark.createDataFrame([(x, y, w) for (x, y), w in links.items()], "a bigint, b bigint, weight double")
            assert {r.id: r.cluster for r in N.linkage_rounds(frame).collect()} == {x: want[x] for x in {*a, *b}}


def test_components_beyond_one_task_give_the_same(spark):
    rng = random.Random(9)
    rows = [(x, y, rng.random()) for g in range(3) for x in range(g * 10, g * 10 + 8) for y in range(x + 1, g * 10 + 8) if rng.random() < 0.5]
    links = spark.createDataFrame(rows, "a bigint, b bigint, cosine double")
    assert {tuple(r) for r in N.linked_clusters(links).collect()} == {tuple(r) for r in N.linked_clusters(links, size=2).collect()}


def test_cosine_join_against_all_pairs(spark):
    import math

    names = [(i, t) for i, t in enumerate(["anton baker", "baker anton", "antom baker", "zelda moon", "zelda mon", "x", "anton bakker", "moon", "", None])]
    vectors = ngram_vectors(spark.createDataFrame(names, "id bigint, text string"))
    vec = {r.id: {v.gram: v.w for v in r.vec} for r in vectors.collect()}
    dot = lambda a, b: sum(w * b.get(g, 0) for g, w in a.items())
    want = {(a, b): dot(vec[a], vec[b]) for a in vec for b in vec if a < b and dot(vec[a], vec[b]) >= 0.3}
    got = {(r.id_a, r.id_b): r.cosine for r in cosine_pairs(vectors, 0.3).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in got)


def test_edits():
    assert [N.edits(*x, 2) for x in (("abcd", "abdc"), ("abcd", "abcd"), ("abcd", "axcd"), ("abcd", "xyz"), ("a", "abcde"))] == [1, 0, 1, 3, 3]


def test_leaks_against_exact_containment(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(100 + i, 60 + 7 * i))) for i in range(12)] + [(90, None), (91, ""), (92, "three words only")]
    docs, want = [], set()
    for d in range(40):
        i = d % 12
        item, filler = items[i][1].split(), words(500 + d, rng.choice((50, 3000)))
        at, kind = rng.randrange(len(filler)), d % 5
        if kind == 0:
            part = item
        elif kind == 1:
            part = item[: len(item) * 2 // 3]
        elif kind == 2:
            part = [w if rng.random() > 0.06 else "changed" for w in item]
        elif kind == 3:
            part = item[: len(item) // 4]
        else:
            part = rng.sample(item, len(item))
        docs.append((d, " ".join(filler[:at] + part + filler[at:]), "x"))
        if kind < 3:
            want.add((d, i))
    docs += [(100, None, "x"), (101, "", "x"), (102, "tiny", "x"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, item_text string")
    assert {tuple(r) for r in L.leaked_items(d, i).collect()} == want
    assert L.leaked_items(d, i.limit(0)).count() == 0 and L.leaked_items(d.limit(0), i).count() == 0


def test_short_and_unspaced_items_are_found(spark):
    docs = [(1, "As was said, three words only stand here."), (2, "three other words only"), (3, "前言不搭后语。今天天气非常好我们去公园散步然后回家吃饭。后记"), (4, "今天下雨"), (5, "only")]
    items = [(92, "Three words only"), (93, "今天天气非常好我们去公园散步然后回家吃饭"), (94, "only")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    assert {tuple(r) for r in L.leaked_items(d, i).collect()} == {(1, 92), (1, 94), (2, 94), (3, 93), (5, 94)}


def test_recall_on_edited_passages():
    """Candidates by MinHash windows against passages with edits, in pieces, inside long texts."""
    rng = random.Random(8)
    items = [(i, " ".join(words(9000 + i, rng.randrange(40, 160)))) for i in range(120)]
    index, found = L.ItemIndex(items), 0
    for i, text in items:
        item = text.split()
        part = [w if rng.random() > 0.05 else "changed" for w in item[: int(len(item) * rng.uniform(0.65, 1.0))]]
        cut = rng.randrange(len(part))
        filler = words(20000 + i, 1500)
        doc = " ".join([*filler[:500], *part[:cut], "so", "they", "say", *part[cut:], *filler[500:]])
        hashes, at = L.word_hashes([doc])
        every = L.shingles(hashes, L.SHINGLE)
        found += any(k == i and index.holds(k, hashes, every) for _, k in index.candidates(every, L.np.array([0, len(every)])))
    assert found >= 0.97 * len(items)
