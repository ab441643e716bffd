"""Payload parsers, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.sources import files, payloads
from sievework.streaming import streams


def table(spark, payload, query="maps"):
    return spark.createDataFrame([(1, query, payload if isinstance(payload, str) else json.dumps(payload)), (2, query, "not json")], "call_id bigint, query string, payload string")


def test_crossref(spark):
    items = [{"DOI": "10.1/x", "title": ["A  b"], "author": [{"given": "Q", "family": "R"}], "issued": {"date-parts": [[2020, 1]]}}, {"title": ["no url"]}, {"URL": "https://d.example/y", "title": ["C"], "issued": {"date-parts": [[3020]]}, "published": {"date-parts": [[2019]]}}]
    got = payloads.crossref(table(spark, {"message": {"items": items}})).collect()
    assert [(r.url, r.title, r.snippet, r.year) for r in got] == [("https://doi.org/10.1/x", "A b", "Q R", 2020), ("https://d.example/y", "C", "", 2019)]


def test_openalex_abstract(spark):
    got = payloads.openalex(table(spark, {"results": [{"id": "i1", "title": "T", "publication_year": 2021, "abstract_inverted_index": {"world": [1], "hello": [0, 2]}}]})).first()
    assert (got.url, got.snippet) == ("i1", "hello world hello")


def test_semantic_scholar_prefers_preprint(spark):
    got = payloads.semantic_scholar(table(spark, {"data": [{"title": "T", "year": 2020, "externalIds": {"ArXiv": "1.2", "DOI": "d"}, "url": "u"}]})).first()
    assert got.url == "https://arxiv.org/abs/1.2"


def test_arxiv_window_and_limit(spark):
    entry = "<entry><id>http://x/{0}</id><title> a\n b </title><summary>s</summary><published>{1}</published></entry>"
    xml = "<feed>" + entry.format(1, "2019-01-01") + entry.format(2, "2023-01-01") + entry.format(3, "") + entry.format(4, "2018-01-01") + "</feed>"
    got = payloads.arxiv(table(spark, xml), last=2020, limit=1).collect()
    assert [(r.url, r.title, r.year) for r in got] == [("http://x/1", "a b", 2019)]


def test_social_gate(spark):
    posts = [{"full_text": "long enough post", "text": "x", "likes": 5, "url": "u1"}, {"text": "long enough post", "like_count": 15, "reposts": 9, "link": "u2"}, {"content": "unknown engagement", "permalink": "u3"}, {"text": "short", "url": "u4", "likes": 99}]
    assert [r.url for r in payloads.social(table(spark, "log line\n" + json.dumps({"items": posts}))).orderBy("pos").collect()] == ["u2", "u3"]


def test_pubmed_order(spark):
    ids = table(spark, {"idlist": ["9", "3", "5"]})
    docs = spark.createDataFrame([(1, json.dumps({"3": {"title": "three", "source": "J", "pubdate": "2001 May"}, "9": {"title": "nine", "fulljournalname": "Full", "pubdate": "x"}}))], "call_id bigint, payload string")
    got = payloads.pubmed(ids, docs).orderBy("pos").collect()
    assert [(r.title, r.snippet, r.year) for r in got] == [("nine", "Full | x", None), ("three", "J | 2001 May", 2001)]


def test_best_copies(spark):
    rows = spark.createDataFrame([("u", 0, 5, None), ("u", 1, 3, "text"), ("v", 2, 1, "v")], "url string, pos bigint, stars bigint, description string")
    assert {tuple(r) for r in payloads.best_copies(rows).collect()} == {("u", 5, "text"), ("v", 1, "v")}
    with pytest.raises(ValueError):
        payloads.parser("nothing")


def test_dblp_wikipedia_github_news_videos(spark):
    got = payloads.dblp(table(spark, {"result": {"hits": {"hit": [{"info": {"title": "Maps", "venue": "CVPR", "year": "2020", "ee": ["e1", "e2"]}}, {"info": {"title": "Maps", "venue": "ICML"}}]}}})).collect()
    assert [(r.url, r.year) for r in got] == [("e1", 2020)]
    assert payloads.wikipedia(table(spark, {"pages": [{"key": "K", "title": "T", "excerpt": "a <b>c</b>"}]})).first().snippet == "a c"
    assert payloads.github(table(spark, {"items": [{"full_name": "a/b", "html_url": "u", "stargazers_count": 3}]})).first().url == "u"
    rss = "<rss><channel><item><title>T</title><link>l1</link><pubDate>d</pubDate><description>&lt;b&gt;x&lt;/b&gt;</description></item><item><title>U</title><link>l2</link></item></channel></rss>"
    assert [r.url for r in payloads.news(table(spark, rss)).collect()] == ["l1", "l2"]
    assert payloads.videos(table(spark, {"data": {"result": [{"aid": 5, "title": "<em>x</em> y"}]}})).first().url.endswith("/av5")


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("<!-- source: https://a.example -->\n\nBody")
    (tmp_path / "b.txt").write_text("no")
    got = files.read_markdown(spark, str(tmp_path)).collect()
    assert [(r.name, r.locator, r.body) for r in got] == [("a.md", "https://a.example", "Body")]
    assert files.package_id(files.read_binaries(spark, str(tmp_path))).startswith("rp_")
    files.write_atomically(str(tmp_path / "c.json"), "{}")
    assert (tmp_path / "c.json").read_text() == "{}"


def test_new_raw_files_and_upsert(spark):
    hits = spark.createDataFrame([("https://a.example/1", 2), ("https://b.example/2", 1), ("https://b.example/2", 3)], "url string, place int")
    stored = spark.createDataFrame([("https://a.example/1",)], "url string")
    got = files.new_raw_files(hits, stored, 2).collect()
    assert len(got) == 1 and got[0].name.startswith("03-b.example-")
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    delta = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in files.upsert(base, delta, "k").collect()} == {("a", 1), ("b", 9), ("c", 3)}
    page = spark.createDataFrame([("head\n<!-- managed:begin -->\nold\n<!-- managed:end -->\ntail", "new")], "p string, b string")
    once = page.select(files.managed_block(F.col("p"), F.col("b")).alias("p")).first().p
    assert once == "head\n<!-- managed:begin -->\nnew\n<!-- managed:end -->\ntail"


def test_batches_replace_themselves(spark, tmp_path):
    write = streams.batch_writer(str(tmp_path / "out"))
    df = spark.range(3)
    for batch in (0, 1, 0):
        write(df, batch)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    fresh = streams.unstored_writer(str(tmp_path / "new"), "id")
    for batch, n in ((0, 3), (1, 5), (1, 5)):
        fresh(spark.range(n), batch)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "new")).collect()) == [0, 1, 2, 3, 4]
