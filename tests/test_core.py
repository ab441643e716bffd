"""Operators of the core on small tables, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import urls as U
from sievework.operators import clean, evidence, matching, search
from sievework.operators.components import connected_components
from sievework.operators.prefix_join import candidate_pairs
from sievework.operators.similar_texts import near_duplicate_winners, shingle_hashes, similar_texts


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr).first()[0]


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("https://www.Site.example:443/a/b/?utm_source=x&id=1#top", "http://site.example/a/b?id=1", True),
        ("https://s.example/r?b=2&a=1", "https://s.example/r?a=1&b=2&gclid=zz", True),
        ("https://s.example/r?id=1", "https://s.example/r?id=2", False),
        ("https://s.example/r?lang=fr", "https://s.example/r", False),
        ("https://s.example/A", "https://s.example/a", False),
        ("https://s.example/%7Eme", "https://s.example/~me", True),
        ("https://s.example", "https://s.example/", True),
    ],
)
def test_page_key(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(U.page_key(F.col("a")), U.page_key(F.col("b"))).first()
    assert (row[0] == row[1]) is same


def test_page_key_of_null(spark):
    assert spark.createDataFrame([(None,)], "u string").select(U.page_key(F.col("u"))).first()[0] is None


def test_header_and_body(spark):
    text = "<!-- source: https://a.example/x -->\n<!-- title: T: one -->\n\nBody\n<!-- later: no -->"
    assert one(spark, T.header_value(F.col("t"), "source"), t=text) == "https://a.example/x"
    assert one(spark, T.header_value(F.col("t"), "title"), t=text) == "T: one"
    assert one(spark, T.header_value(F.col("t"), "later"), t=text) is None
    assert one(spark, T.body_of(F.col("t")), t=text) == "Body\n<!-- later: no -->"


def test_clean_drops_menu_ads_tail(spark):
    para = "This is a long paragraph of real content that ends with a full stop and goes on. " * 4
    text = f"Home\nAbout\nContact\nLogin\n\nsponsored content here\n\n{para}\n\n## References\nold book"
    out = clean.clean_documents(spark.createDataFrame([(1, text), (2, None), (3, "%PDF-1.4 xx"), (4, "")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert out[0].cleaned == para.strip() and out[0].issues == []
    assert out[1].cleaned is None and out[2].cleaned == "" and "binary_or_unparsed_pdf" in out[2].issues and out[3].issues == ["too_short"]


def test_chunk_spans_match_loop(spark):
    texts = {1: "abcdefghij", 2: "", 3: "   ", 4: "x" * 25, 5: None, 6: "é漢字🙂" * 6}
    got = {(r.doc_id, r.start): r.chunk for r in evidence.chunk_spans(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), 10, 3).collect()}
    want = {}
    for k, t in texts.items():
        for s in range(0, len(t or ""), 7):
            if t[s : s + 10].strip():
                want[k, s] = t[s : s + 10]
            if s + 10 >= len(t):
                break
    assert got == want


def test_prefix_join_loses_nothing(spark):
    rng = random.Random(1)
    sets = [(i, [rng.randrange(40) * 100 + k for k in range(12) if rng.random() < 0.9]) for i in range(60)]
    sets += [(i + 100, list(s)) for i, s in sets[:10]] + [(999, []), (1000, None)]
    got = {tuple(r) for r in candidate_pairs(spark.createDataFrame(sets, "id bigint, tokens array<bigint>"), 3).collect()}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted((i, s) for i, s in sets if s), 2) if len(set(x) & set(y)) >= 3}
    assert want <= got


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200), (102, 100), (100, 101)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100 and got[200] == 200
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(4000)]
    texts = []
    for i in range(30):
        base = words[i * 100 : i * 100 + 90]
        texts.append((i * 3, " ".join(base)))
        for k, share in ((1, 0.02), (2, 0.2)):
            texts.append((i * 3 + k, " ".join(w if rng.random() > share else "zz" for w in base)))
    got = {tuple(r) for r in similar_texts(spark.createDataFrame(texts, "id bigint, text string")).collect()}
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in texts}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 10
    # A text shorter than a shingle is its own only one.
    assert len(shingle_hashes("abcd")) == 1 and len(shingle_hashes("")) == 0 and shingle_hashes("abcd")[0] not in shingle_hashes("abcde")


def test_winners(spark):
    long = "a sentence that is used again and again with other words each time " * 5
    rows = [(1, long), (2, long + "!"), (3, "short"), (4, None), (5, long)]
    got = {r.doc_id: r.winner_id for r in near_duplicate_winners(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 2, 2: 2, 5: 2, 3: 3}


def test_facts_first_place_last_topic_and_merge(spark):
    chunks = spark.createDataFrame([(1, 7, [("alpha", "t1"), ("nope", "t")]), (2, 7, [("alpha", "t2"), (None, "x")]), (3, None, None)], "chunk_id bigint, fetch_id bigint, claims array<struct<quote string, topic string>>")
    pages = spark.createDataFrame([(7, "https://a.example", "an alpha here")], "fetch_id bigint, url string, markdown string")
    facts = evidence.facts_of(evidence.locate_quotes(chunks, pages)).collect()
    assert len(facts) == 1 and (facts[0].start, facts[0].topic, facts[0].chunk_id) == (3, "t2", 1)
    base = spark.createDataFrame([("c1", "q", "t", "s"), ("c2", "q2", "t", "s")], "claim_id string, quote string, topic string, source_id string")
    delta = spark.createDataFrame([("c1", "q", "new", "s"), ("c2", "other", "t", "s"), ("c3", "q3", "t", "s")], base.schema)
    kinds = {r.claim_id: (r.kind, r.topic) for r in evidence.merge_facts(base, delta).collect()}
    assert kinds == {"c1": ("skipped", "t"), "c2": ("conflict", "t"), "c3": ("new_fact", "t")}
    with pytest.raises(ValueError):
        evidence.assert_empty(evidence.merge_facts(base, delta).where("kind = 'conflict'"), "conflict")


def test_funnel_counts(spark):
    hits = [("web", "u1", "solar power", "solar power plant", None, "u1", 1), ("web", "u1", "solar power", "solar power plant", None, "u1", 2), ("web", "u2", "solar power", "cats", None, "u2", 3), ("pm", "u3", "", "x", None, "u3", 4)]
    h = spark.createDataFrame(hits, "engine string, url_key string, query string, title string, snippet string, url string, order bigint")
    calls = spark.createDataFrame([("web", False), ("web", True), ("pm", False), ("none", True)], "engine string, failed boolean")
    got = {r.engine: tuple(r)[1:] for r in search.funnel(calls, h, 0.5).collect()}
    assert got == {"web": (2, 3, 1, 1, 1, 1), "pm": (1, 1, 0, 0, 0, 1), "none": (1, 0, 1, 0, 0, 0)}


def test_greedy_and_best(spark):
    scored = spark.createDataFrame([("c", 1, 1, 0.9), ("c", 1, 2, 0.8), ("c", 2, 1, 0.85), ("c", 2, 2, 0.1)], "case_id string, i bigint, j bigint, score double")
    assert {(r.i, r.j) for r in matching.greedy_pairs(scored).collect()} == {(1, 1), (2, 2)}
    p = spark.createDataFrame([(1, "Deep Nets for Maps"), (2, "Unseen"), (3, "")], "paper_id bigint, title string")
    v = spark.createDataFrame([(10, "deep nets for maps (talk)"), (11, "deep nets for maps (talk)")], "video_id bigint, video_title string")
    got = {r.paper_id: r.video_id for r in matching.best_match(p, v, 0.7).collect()}
    assert got == {1: 10, 2: None, 3: None}


def test_interval_titles(spark):
    c = spark.createDataFrame([("v", 0.0, 300.0), ("v", 300.0, 600.0), ("v", 5000.0, 5300.0)], "video_id string, start_sec double, end_sec double")
    s = spark.createDataFrame([("v", 10.0, 20.0, " "), ("v", 30.0, 320.0, "one"), ("v", 400.0, 410.0, "two")], "video_id string, seg_start double, seg_end double, text string")
    assert {r.start_sec: r.first_text for r in matching.interval_titles(c, s).collect()} == {0.0: "one", 300.0: "one", 5000.0: None}


def test_scalars(spark):
    assert one(spark, T.redact(F.col("t")), t="https://u:pw@h/x sk-abcdefghij") == "https://u:***REDACTED***@h/x ***REDACTED***"
    assert one(spark, T.slug(F.col("t")), t="  Ünder & Over ") == "nder-over" and one(spark, T.slug(F.col("t")), t="!!") == "untitled"
    assert one(spark, T.word_count(F.col("t")), t="two words 漢字") == 4
    assert one(spark, T.error_rate(F.col("a"), F.col("b")), a="abc", b="abd") == pytest.approx(1 / 3)
    assert one(spark, T.secret_rules(F.col("t")), t="password = abcdefghijklmnop1") == ["assigned_secret"]
    assert spark.createDataFrame([(61,), (3671,), (None,)], "s bigint").select(T.duration_text(F.col("s"))).collect() == [("1:01",), ("1:01:11",), ("",)]


@pytest.mark.parametrize(
    "url,why",
    [
        ("https://example.org/a", None),
        ("ftp://example.org", "scheme"),
        (None, "scheme"),
        ("https://u:p@example.org", "credentials"),
        ("https://example.org/?a=1&Api_Key=2", "credentials"),
        ("https://example.org/#x-token=2", "credentials"),
        ("https://example.org/?monkey=2", None),
        ("https:///x", "host"),
        ("http://10.1.2.3/", "network"),
        ("http://8.8.8.8:80/", None),
        ("http://172.32.0.1", None),
        ("http://[::1]/", "network"),
        ("http://[2606:4700::1]/", None),
    ],
)
def test_refusal(spark, url, why):
    assert spark.createDataFrame([(url,)], "u string").select(U.refusal(F.col("u"))).first()[0] == why


def test_platforms(spark):
    rows = [("https://youtu.be/abcdef1",), ("https://www.bilibili.com/video/BV1xx",), ("https://a.example/video/1",)]
    got = spark.createDataFrame(rows, "u string").select(U.platform(F.col("u")), U.video_id(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("youtube", "abcdef1"), ("bilibili", "BV1xx"), (None, "")]


def test_retained_findings(spark):
    f = "finding_id string, priority string, query string"
    current = spark.createDataFrame([("coverage:a", "high", "qa"), ("model:x", "low", "new")], f)
    prior = spark.createDataFrame([("model:x", "high", "old"), ("model:y", "low", "y"), ("model:z", "low", "z"), ("coverage:old", "high", "o")], f)
    res = spark.createDataFrame([("model:y", "done", ["c1", "c2"]), ("model:z", "done", ["c1"])], "finding_id string, reason string, claim_ids array<string>")
    facts, new = spark.createDataFrame([("c1",), ("c2",)], "claim_id string"), spark.createDataFrame([("c2",)], "claim_id string")
    out = evidence.retained_findings(current, prior, res, facts, new)
    assert {tuple(r) for r in out.collect()} == {("coverage:a", "high", "qa"), ("model:x", "high", "old"), ("model:z", "low", "z")}
    assert [r.query for r in evidence.targeted_queries(out, 2).collect()] == ["qa", "old"]


def test_packed_paragraphs_and_tags(spark):
    rows = spark.createDataFrame([("aaa\n\nbbb\n\n" + "c" * 20 + "\n\nd", ["A", " b", ""], ["a", "C"])], "t string, x array<string>, y array<string>")
    r = rows.select(evidence.packed_paragraphs(F.col("t"), 10).alias("p"), evidence.merged_tags(F.col("x"), F.col("y"), F.lit(None).cast("array<string>")).alias("tags")).first()
    assert r.p == ["aaa\n\nbbb", "c" * 20, "d"] and r.tags == ["A", "b", "C"]


def test_plans_push_filters_and_columns(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.example/x", "t", 3)], "hit_id bigint, url string, title string, other int").write.parquet(str(tmp_path / "h.parquet"))
    hits = spark.read.parquet(str(tmp_path / "h.parquet"))
    plan = search.first_wins(hits.where("hit_id > 0").select("url", "hit_id"), ["url"], ["hit_id"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(hit_id,0)" in plan and "other" not in plan and "title" not in plan


def test_families_against_loop(spark):
    from sievework.operators.similar_texts import content_families

    rng = random.Random(8)
    base = " ".join(f"word{rng.randrange(900)}" for _ in range(400))
    texts = [(10, base)]
    for i in range(11, 22):  # a chain of small edits: each is near its neighbours only
        prev = texts[-1][1].split()
        prev[rng.randrange(400)] = f"new{i}"
        texts.append((i, " ".join(prev)))
    texts += [(30, base.upper()), (31, "other text"), (32, None), (33, "x"), (34, "x")]
    reps, want = [], {}
    for i, t in sorted((i, t) for i, t in texts if t is not None):
        t = " ".join(t.split()).lower()
        s = {t[k : k + 7] for k in range(max(1, len(t) - 6))}
        want[i] = next((r for r, u in reps if len(s & u) >= 0.98 * len(s | u)), i)
        if want[i] == i:
            reps.append((i, s))
    got = {r.id: r.family for r in content_families(spark.createDataFrame(texts, "id bigint, text string")).collect()}
    assert got == want and len(set(want.values())) > 3


def test_first_leaders_keep_the_order(spark):
    from sievework.operators.similar_texts import first_leaders

    links = spark.createDataFrame([(1, 2), (2, 3), (3, 5), (4, 5)], "id_a bigint, id_b bigint")
    assert {tuple(r) for r in first_leaders(links).collect()} == {(2, 1), (5, 3)}


def test_more_scalars(spark):
    df = spark.createDataFrame([("v1.10.2", "v1.9", "sha256:" + "A" * 64, "clean", ["clean"], 2.0)], "a string, b string, h string, s string, done array<string>, d double")
    none = F.array().cast("array<string>")
    r = df.select((T.version_key(F.col("a")) > T.version_key(F.col("b"))).alias("gt"), T.bare_hash(F.col("h")).alias("h"), T.stage_status(F.col("s"), F.col("done"), none).alias("st"), T.frame_times(F.col("d"), 10).alias("t")).first()
    assert r.gt and r.h == "a" * 64 and r.st == "completed" and r.t == [0.0, 0.5, 1.0, 1.5]
    with pytest.raises(Exception, match="not a SHA-256"):
        df.select(T.bare_hash(F.col("a"))).collect()


@pytest.mark.parametrize(
    "host,blocked",
    [
        ("[1::1]", True), ("[100::1]", False), ("[ab::1]", True), ("[fe8::1]", False), ("[fc1::1]", False), ("[fe80::1%eth0]", True), ("[fd00:1:2:3:4:5:6:7]", True), ("[2001:db8::7]", False), ("[::1]", True), ("[::]", True),
        ("[ff02::1]", True), ("[::ffff:10.0.0.1]", True), ("[2606::1.2.3.4]", False), ("[1::2::3]", True), ("[nonsense:]", True), ("10.1.2.3", True), ("100.64.0.1", True), ("100.128.0.1", False), ("198.19.255.255", True), ("8.8.8.8", False), ("example.org", None),
    ],
)
def test_blocked_addresses(spark, host, blocked):
    assert spark.createDataFrame([(host,)], "h string").select(U.blocked_address(F.col("h"))).first()[0] is blocked


def test_first_json_tries_each_bracket(spark):
    rows = [('info [x] {"a": 1} {"b": 2}', '{"a":1}'), ("no [ json { here", None), (None, None), ("", None), ('[1, 2] {"a": 1}', "[1,2]"), ('{"a": {"b": [1]}}', '{"a":{"b":[1]}}')]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").orderBy("k").select(T.first_json(F.col("t")).cast("string")).collect()
    assert [r[0] for r in got] == [w for _, w in rows]


def test_unescape_as_the_standard_library(spark):
    import html

    texts = ["a &lt;b&gt; &amp;amp; &#233;&#xe9; &hellip; &nosuch; & &#0; &#55296; &#1114112;", "plain", "", None, "&amp;lt; stays once"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.unescape(F.col("t"))).collect()]
    assert got[0] == "a <b> &amp; éé … &nosuch; & &#0; &#55296; &#1114112;" and got[1:] == ["plain", "", None, html.unescape(texts[4])]


def test_long_documents_clean_in_linear_time(spark):
    import time

    def seconds(n):
        d = spark.createDataFrame([(1, "\n".join(f"Line {i} of a long text that says something new, as lines of texts do." if i % 5 else "" for i in range(n)))], "doc_id bigint, text string")
        began = time.time()
        assert clean.clean_documents(d).select(F.length("cleaned")).first()[0] == T.MAX_CONTENT
        return time.time() - began

    seconds(2_000)
    assert seconds(64_000) < 20


def test_menu_marks_against_brute_force(spark):
    rng = random.Random(4)
    for _ in range(15):
        sizes = [rng.choice([0, 5, 39, 40, 90]) for _ in range(rng.randrange(1, 30))]
        got = spark.createDataFrame([(sizes,)], "s array<int>").select(clean.menu_marks(F.col("s"))).first()[0]
        menu, k = [False] * len(sizes), 0
        while k < len(sizes):
            e = k
            while e < len(sizes) and sizes[e]:
                e += 1
            if e - k >= 3 and sum(x < 40 for x in sizes[k:e]) >= 0.7 * (e - k):
                menu[k:e] = [True] * (e - k)
            k = max(e, k + 1)
        assert [x == "x" for x in got[: len(sizes)]] == menu


def test_funnel_capacity(spark):
    hits = spark.createDataFrame([("web", f"u{i % 4}", "tides", "tides", "", f"u{i % 4}", i) for i in range(6)] + [("x", "u9", "tides", "other", "", "u9", 9)], "engine string, url_key string, query string, title string, snippet string, url string, order bigint")
    calls = spark.createDataFrame([("web", False), ("x", True)], "engine string, failed boolean")
    got = {r.engine: tuple(r)[1:] for r in search.funnel(calls, hits, 0.5, capacity=3).collect()}
    assert got == {"web": (1, 6, 0, 1, 2, 3), "x": (1, 1, 1, 1, 0, 0)}


def test_take_until_and_covers(spark):
    rows = spark.createDataFrame([("a", i, i % 3 == 2) for i in range(12)] + [("b", 1, False)], "k string, i bigint, m boolean")
    assert {(r.k, r.i) for r in search.take_until(rows, ["k"], "i", F.col("m"), 2).collect()} == {("a", i) for i in range(6)} | {("b", 1)}
    want = spark.createDataFrame([("p",), ("q",), ("r",)], "id string")
    placed = spark.createDataFrame([("p",), ("q",), ("q",), ("z",)], "id string")
    assert {tuple(r) for r in evidence.exact_cover(want, placed, "id").collect()} == {("q", 1, 2), ("r", 1, 0), ("z", 0, 1)}


def test_front_matter_and_titles(spark):
    texts = ['---\ntitle: "A: b"\ntags: x, y\ntitle: other\nnot a pair\n---\nBody\n', "no header", "---\nopen: 1\n", "", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.front_matter(F.col("t")).alias("f")).select("f.*").collect()
    assert got[0].meta == {"title": "A: b", "tags": "x, y"} and got[0].body == "Body\n" and [g.body for g in got[1:]] == texts[1:]
    d = spark.createDataFrame([("<!-- title: Said -->\n# Head\ntext",), ("# Head #1\n\nsome  text",), ("plain",)], "t string").select(T.title_and_excerpt(F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in d] == [("Said", "# Head text"), ("Head #1", "# Head #1 some text"), (None, "plain")]


def test_best_match_against_all_pairs(spark):
    rng = random.Random(7)
    title = lambda: " ".join(rng.sample(["a1", "b2", "c3", "d4", "e5", "f6", "g7"], rng.randrange(1, 6)))
    papers, videos = [(i, title()) for i in range(60)] + [(99, None), (98, "")], [(i, title()) for i in range(80)] + [(500, None)]
    got = {r.paper_id: r.video_id for r in matching.best_match(spark.createDataFrame(papers, "paper_id bigint, title string"), spark.createDataFrame(videos, "video_id bigint, video_title string"), 0.6).collect()}
    tokens = lambda t: set((t or "").split())
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    for i, t in papers:
        best = max(((jac(tokens(t), tokens(v)), -k) for k, v in videos), default=(0, 0))
        assert got[i] == (-best[1] if best[0] >= 0.6 else None)
