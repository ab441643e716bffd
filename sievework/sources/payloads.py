"""Recorded payloads of search connectors, parsed to one shape of hit.

A connector is a table of payloads (``call_id, query, payload``); each parser gives ``call_id, pos,
url, title, snippet, year``. Network access is not part of the engine: a live reader writes payload
tables. Payloads that do not parse give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T


def _items(payloads: DataFrame, path: str, schema: str) -> DataFrame:
    """Explodes the JSON array at ``path`` (dots between fields; '' for the top)."""
    array = f"array<struct<{schema}>>"
    kind = array
    for name in reversed(path.split(".") if path else []):
        kind = f"struct<{name}:{kind}>"
    doc = F.from_json("payload", kind if path else array)
    items = F.col(f"d.{path}") if path else F.col("d")
    return payloads.select("call_id", "query", doc.alias("d")).select("call_id", "query", F.posexplode(items).alias("pos", "i"))


def _hits(rows: DataFrame, url: Column, title: Column, snippet: Column, year: Column | None = None) -> DataFrame:
    out = rows.select("call_id", "query", "pos", url.alias("url"), F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"), F.coalesce(snippet, F.lit("")).alias("snippet"), (year if year is not None else F.lit(None)).cast("int").alias("year"))
    return out.where("url is not null and url <> ''")


def no_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""))


def year_ok(year: Column, first: int | None, last: int | None) -> Column:
    """Year window; an unknown year fails when there is a bound."""
    if first is None and last is None:
        return F.lit(True)
    ok = F.lit(True)
    if first is not None:
        ok = ok & (year >= first)
    if last is not None:
        ok = ok & (year <= last)
    return F.coalesce(ok, F.lit(False))


def crossref(payloads: DataFrame) -> DataFrame:
    date = "struct<`date-parts`:array<array<int>>>"
    rows = _items(payloads, "message.items", f"URL:string,DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,issued:{date},published:{date},`published-print`:{date},`published-online`:{date}")
    years = [F.expr(f"try_element_at(try_element_at(i.`{c}`.`date-parts`, 1), 1)") for c in ("issued", "published", "published-print", "published-online")]
    year = F.coalesce(*(F.when(y.between(1500, 2100), y) for y in years))
    names = F.array_join(F.transform(F.slice("i.author", 1, 5), lambda a: F.concat_ws(" ", a["given"], a["family"])), ", ")
    return _hits(rows, F.coalesce("i.URL", F.concat(F.lit("https://doi.org/"), "i.DOI")), F.expr("try_element_at(i.title, 1)"), names, year)


def openalex(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "results", "id:string,doi:string,title:string,publication_year:int,cited_by_count:bigint,abstract_inverted_index:map<string,array<int>>,best_oa_location:struct<pdf_url:string,landing_page_url:string>")
    words = F.flatten(F.transform(F.map_entries("i.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    abstract = F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ")
    return _hits(rows, F.coalesce("i.best_oa_location.pdf_url", "i.best_oa_location.landing_page_url", "i.doi", "i.id"), F.col("i.title"), abstract, F.col("i.publication_year"))


def semantic_scholar(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "data", "title:string,abstract:string,year:int,url:string,citationCount:bigint,externalIds:map<string,string>,openAccessPdf:struct<url:string>")
    ids = lambda k, p: F.concat(F.lit(p), F.try_element_at(F.col("i.externalIds"), F.lit(k)))
    return _hits(rows, F.coalesce("i.openAccessPdf.url", ids("ArXiv", "https://arxiv.org/abs/"), ids("DOI", "https://doi.org/"), "i.url"), F.col("i.title"), F.coalesce("i.abstract", F.lit("")), F.col("i.year"))


def pubmed(ids: DataFrame, summaries: DataFrame) -> DataFrame:
    """Ids in their order (``call_id, query, payload`` with a list) looked up in summaries
    (``call_id, payload`` with documents by id)."""
    order = ids.select("call_id", "query", F.posexplode(F.from_json("payload", "struct<idlist:array<string>>").getField("idlist")).alias("pos", "uid"))
    docs = summaries.select("call_id", F.explode(F.from_json("payload", "map<string,struct<title:string,fulljournalname:string,source:string,pubdate:string>>")).alias("uid", "d"))
    rows = order.join(docs, ["call_id", "uid"], "left").where("d is not null")
    return _hits(rows, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "uid", F.lit("/")), F.col("d.title"), F.concat_ws(" | ", F.coalesce("d.fulljournalname", "d.source"), "d.pubdate"), F.expr("try_cast(substring(d.pubdate, 1, 4) as int)"))


def wikipedia(payloads: DataFrame, language: str = "en") -> DataFrame:
    rows = _items(payloads, "pages", "key:string,title:string,excerpt:string,description:string")
    return _hits(rows, F.concat(F.lit(f"https://{language}.wikipedia.org/wiki/"), "i.key"), F.col("i.title"), no_tags(F.coalesce("i.excerpt", "i.description")))


def github(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "items", "full_name:string,html_url:string,description:string,stargazers_count:bigint,forks_count:bigint,language:string,pushed_at:string,topics:array<string>,homepage:string")
    text = F.concat_ws(" | ", F.concat(F.lit("stars "), "i.stargazers_count"), "i.language", "i.description")
    return _hits(rows, F.col("i.html_url"), F.col("i.full_name"), text, F.expr("try_cast(substring(i.pushed_at, 1, 4) as int)"))


def best_copies(repos: DataFrame) -> DataFrame:
    """Per ``url`` the copy with most stars (``stars, description, pos``), with the description of
    an earlier copy where its own is missing."""
    best = repos.groupBy("url").agg(F.max_by(F.struct("stars", "description"), F.struct("stars", -F.col("pos"))).alias("b"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("pos"))).alias("other"))
    return best.select("url", "b.stars", F.coalesce("b.description", "other").alias("description"))


def dblp(payloads: DataFrame, venue: str = "CVPR") -> DataFrame:
    """Venue and query must fit; authors may be one or several, links one or several."""
    rows = _items(payloads, "result.hits.hit", "info:struct<title:string,venue:string,year:string,ee:string,url:string,key:string>")
    ee = F.coalesce(F.from_json("i.info.ee", "array<string>")[0], F.col("i.info.ee"))
    url = F.coalesce(ee, "i.info.url", F.concat(F.lit("https://dblp.org/rec/"), "i.info.key"))
    fits = F.upper("i.info.venue").contains(venue) & F.arrays_overlap(T.title_tokens(F.col("query")), T.title_tokens(F.col("i.info.title")))
    return _hits(rows.where(fits), url, F.col("i.info.title"), F.concat_ws(" ", "i.info.venue", "i.info.year"), F.expr("try_cast(i.info.year as int)"))


def _first_of(item: str, *names: str) -> Column:
    return F.coalesce(*(F.when(F.expr(f"try_variant_get({item}, '$.{n}', 'string')") != "", F.expr(f"try_variant_get({item}, '$.{n}', 'string')")) for n in names))


def loose_items(payloads: DataFrame, *containers: str) -> DataFrame:
    """Items of noisy JSON output under any of several container names, or at the top."""
    doc = payloads.select("call_id", "query", T.first_json(F.col("payload")).alias("v"))
    arrays = [F.expr(f"try_variant_get(v, '$.{c}', 'array<variant>')") for c in containers]
    return doc.select("call_id", "query", F.posexplode(F.coalesce(*arrays, F.expr("try_variant_get(v, '$', 'array<variant>')"))).alias("pos", "i"))


def engagement(item: str = "i") -> Column:
    """Likes, reposts and replies by whichever name they have; null when none is there."""
    groups = (("likes", "favorite_count", "like_count"), ("retweets", "retweet_count", "reposts"), ("replies", "reply_count"))
    got = [F.coalesce(*(F.expr(f"try_variant_get({item}, '$.{n}', 'double')") for n in g)) for g in groups]
    some = got[0].isNotNull() | got[1].isNotNull() | got[2].isNotNull()
    return F.when(some, sum((F.coalesce(g, F.lit(0.0)) for g in got), F.lit(0.0)))


def social(payloads: DataFrame, least: float = 20) -> DataFrame:
    """Posts of a social network: alternative field names, noise dropped, and a gate on engagement
    that posts of unknown engagement pass."""
    rows = loose_items(payloads, "tweets", "results", "items", "data", "timeline")
    text, score = _first_of("i", "full_text", "text", "content"), engagement()
    kept = rows.where((F.length(F.trim(text)) >= 8) & (F.coalesce(score, F.lit(least)) >= least))
    return _hits(kept, _first_of("i", "url", "link", "permalink"), F.substring(text, 1, 80), text)


def browser(payloads: DataFrame) -> DataFrame:
    rows = loose_items(payloads, "results", "items", "data", "papers", "entries")
    hits = _hits(rows, _first_of("i", "url", "link", "href"), _first_of("i", "title", "name"), _first_of("i", "snippet", "abstract", "description"))
    return hits.where("url rlike '^https?://'")


def arxiv(payloads: DataFrame, first: int | None = None, last: int | None = None, limit: int = 50) -> DataFrame:
    """Atom entries within the year window, ``limit`` of each call."""
    doc = F.from_xml("payload", "entry array<struct<id:string,title:string,summary:string,published:string>>", {"rowTag": "feed"})
    rows = payloads.select("call_id", "query", F.posexplode(doc.getField("entry")).alias("pos", "i"))
    year = F.expr("try_cast(substring(trim(i.published), 1, 4) as int)")
    hits = _hits(rows, F.trim("i.id"), F.col("i.title"), F.trim(F.regexp_replace("i.summary", r"\s+", " ")), year).where(year_ok(F.col("year"), first, last))
    from sievework.operators.search import top_per_key

    return top_per_key(hits, ["call_id"], ["pos"], limit).drop("rank")


def news(payloads: DataFrame) -> DataFrame:
    doc = F.from_xml("payload", "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string>>>", {"rowTag": "rss"})
    rows = payloads.select("call_id", "query", F.posexplode(doc.getField("channel").getField("item")).alias("pos", "i"))
    return _hits(rows, F.trim("i.link"), no_tags(F.col("i.title")), F.concat_ws(" ", F.trim("i.pubDate"), no_tags(F.col("i.description"))))


def videos(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "data.result", "bvid:string,aid:bigint,title:string,author:string,duration:string,description:string")
    url = F.concat(F.lit("https://www.bilibili.com/video/"), F.coalesce(F.when(F.col("i.bvid") != "", F.col("i.bvid")), F.concat(F.lit("av"), "i.aid")))
    return _hits(rows, url, no_tags(F.col("i.title")), F.concat_ws(" | ", "i.author", "i.duration", no_tags(F.col("i.description"))))


#: Parser of each engine; an engine may have a second name.
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "crossref": crossref, "openalex": openalex, "semantic_scholar": semantic_scholar, "wikipedia": wikipedia, "github": github, "cvpr": dblp,
    "x": social, "twitter": social, "opencli": browser, "arxiv": arxiv, "scholar": arxiv, "google_news": news, "bilibili": videos,
}


def parser(engine: str) -> Callable[..., DataFrame]:
    if engine not in PARSERS:
        raise ValueError(f"unknown search engine: {engine}")
    return PARSERS[engine]
