"""Queries over the test tables for the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import urls as U
from sievework.operators import clean, evidence, matching, search
from sievework.session import table, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from sievework.plans import more  # noqa: F401  adds its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_graph(spark, sf_dir)


# --- text and documents ---------------------------------------------------------------------------

# DuckDB's \s is ASCII; the same classes are written out on both sides.
_SP = r"[ \t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIPPED = lambda c: f"regexp_replace(regexp_replace({c}, '^{_SP}+', ''), '{_SP}+$', '')"
_BODY = r"regexp_replace(regexp_replace(text, '^(?:[ \t]*<!--[^\n]*-->[ \t]*(?:\n|$))+', ''), '^[\r\n]+', '')"


@query(
    rf"""
SELECT doc_id,
  nullif(regexp_extract(regexp_extract(text, '^((?:[ \t]*<!--[^\n]*-->[ \t]*\n?)*)', 1), '<!--\s*source:\s*(.*?)\s*-->', 1), '') AS locator,
  nullif(regexp_extract(regexp_extract(text, '^((?:[ \t]*<!--[^\n]*-->[ \t]*\n?)*)', 1), '<!--\s*title:\s*(.*?)\s*-->', 1), '') AS header_title,
  nullif(regexp_extract(regexp_extract(text, '^((?:[ \t]*<!--[^\n]*-->[ \t]*\n?)*)', 1), '<!--\s*evidence_kind:\s*(.*?)\s*-->', 1), '') AS header_kind,
  length({_BODY}) AS body_length, sha256({_BODY}) AS content_sha256
FROM documents WHERE text IS NOT NULL"""
)
def parse_sources(spark, sf_dir):
    """Header parse and body hash of each document."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    t, body = F.col("text"), T.body_of(F.col("text"))
    return d.select(
        "doc_id", T.header_value(t, "source").alias("locator"), T.header_value(t, "title").alias("header_title"), T.header_value(t, "evidence_kind").alias("header_kind"), F.length(body).cast("bigint").alias("body_length"), T.content_hash(body).alias("content_sha256")
    )


@query("SELECT fetch_id, substr(sha256(coalesce(nullif(url, ''), markdown)), 1, 16) AS source_id, sha256(markdown) AS content_sha256, 'sha256:' || substr(sha256(url), 1, 16) AS url_hash, substr(sha256(url), 1, 6) AS short_hash FROM fetch_results")
def source_identity(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "fetch_results").select("fetch_id", T.source_id(url, F.col("markdown")).alias("source_id"), T.content_hash(F.col("markdown")).alias("content_sha256"), F.concat(F.lit("sha256:"), F.substring(F.sha2(url, 256), 1, 16)).alias("url_hash"), F.substring(F.sha2(url, 256), 1, 6).alias("short_hash"))


@query(
    rf"""
WITH base AS (SELECT doc_id, text, {_BODY} AS b FROM documents WHERE text IS NOT NULL),
bin AS (SELECT *, length(substr(b,1,4000)) > 0 AND (contains(substr(b,1,200), '%PDF') OR contains(substr(b,1,4000), 'FlateDecode') OR contains(substr(b,1,4000), '/Filter')
   OR length(substr(b,1,4000)) - length(regexp_replace(substr(b,1,4000), '[\x{{fffd}}\x{{00}}-\x{{08}}\x0b\x0c\x{{0e}}-\x{{1f}}]', '', 'g')) > 0.15 * length(substr(b,1,4000))) AS is_bin FROM base),
html AS (SELECT *, regexp_replace({"".join("regexp_replace(" for _ in T.HTML_BLOCKS)}b{"".join(f", '<{t}[^>]*>.*?</{t}>', '', 'gis')" for t in T.HTML_BLOCKS)}, '<[^>]+>', '', 'g') AS h FROM bin),
ln AS (SELECT doc_id, unnest(string_split(h, E'\n')) AS x, unnest(range(len(string_split(h, E'\n')))) AS i FROM html),
a AS (SELECT doc_id, i, x, length({_STRIPPED('x')}) AS n FROM ln WHERE NOT regexp_matches(x, '(?i)\b(advertisement|sponsored|promoted|ad[_\-]?block|adsbygoogle)\b')),
r AS (SELECT *, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM a),
k AS (SELECT *, count(*) FILTER (n > 0) OVER w AS size, count(*) FILTER (n > 0 AND n < 40) OVER w AS short FROM r WINDOW w AS (PARTITION BY doc_id, run)),
m AS (SELECT * FROM k WHERE n = 0 OR NOT (size >= 3 AND short >= 0.7 * size)),
s AS (SELECT *, coalesce(min(i) FILTER (NOT regexp_matches(x, '^\s*[-*]?\s*\[[^\]]*\]\([^)]*\)\s*$|^\s*https?://\S+\s*$') AND ((n >= 40 AND regexp_matches(x, '[.!?。！？]')) OR n >= 120)) OVER (PARTITION BY doc_id), -1) AS st FROM m),
u AS (SELECT *, min(i) FILTER (i >= st AND regexp_matches(x, '(?i)^\s*#{{1,6}}\s*(Contributing|License|References|参考文献|致谢|License & Credits)\b')) OVER (PARTITION BY doc_id) AS tail FROM s),
j AS (SELECT doc_id, string_agg(x, E'\n' ORDER BY i) AS c FROM u WHERE i >= st AND (tail IS NULL OR i < tail) GROUP BY doc_id),
f AS (SELECT b.doc_id, b.text, CASE WHEN b.is_bin THEN '' ELSE coalesce(substr({_STRIPPED("regexp_replace(c, E'\\n{3,}', E'\\n\\n', 'g')")}, 1, 50000), '') END AS cleaned, b.is_bin FROM bin b LEFT JOIN j USING (doc_id))
SELECT doc_id, length(text) AS original_size, length(cleaned) AS cleaned_size, sha256(cleaned) AS cleaned_sha256, is_bin AS is_binary, length(cleaned) < 200 AS too_short FROM f"""
)
def clean_documents(spark, sf_dir):
    """Cleaning chain and per-document quality."""
    out = clean.clean_documents(table(spark, sf_dir, "documents").where("text is not null"))
    return out.select("doc_id", "original_size", "cleaned_size", T.content_hash(F.col("cleaned")).alias("cleaned_sha256"), F.array_contains("issues", "binary_or_unparsed_pdf").alias("is_binary"), F.array_contains("issues", "too_short").alias("too_short"))


@query("SELECT evidence, count(*) AS documents, count(*) FILTER (evidence = 'body') AS bodies FROM (SELECT coalesce(nullif(evidence_kind, ''), 'body') AS evidence, text FROM documents) WHERE length(text) >= 200 GROUP BY evidence")
def evidence_kinds(spark, sf_dir):
    """Kind filter before anything expensive, with the minimum length."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 200).select(F.coalesce(F.when(F.col("evidence_kind") != "", F.col("evidence_kind")), F.lit("body")).alias("evidence"))
    return d.groupBy("evidence").agg(F.count("*").alias("documents"), F.count_if(F.col("evidence") == "body").alias("bodies"))


@query(
    """
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 1000) / 900.0) AS INT)) + 1)) * 900 AS start FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, start, substr(text, start + 1, 1000) AS chunk FROM s), q AS (SELECT * FROM p WHERE length(%s) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start, length(chunk) AS chunk_length, sha256(chunk) AS chunk_sha256 FROM q"""
    % _STRIPPED("chunk")
)
def chunk_spans(spark, sf_dir):
    out = evidence.chunk_spans(table(spark, sf_dir, "documents"), 1000, 100)
    return out.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("start").cast("bigint").alias("start"), F.length("chunk").cast("bigint").alias("chunk_length"), T.content_hash(F.col("chunk")).alias("chunk_sha256"))


@query("SELECT doc_id, length(regexp_replace(text, '[^一-鿿]', '', 'g')) + len(regexp_extract_all(text, '[A-Za-z]+')) AS words FROM documents WHERE text IS NOT NULL")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


@query(
    r"""SELECT doc_id, rule FROM documents, (VALUES ('private_key', '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----'), ('openai', '\bsk-(proj-|ant-)?[A-Za-z0-9_-]{20,}\b'), ('github', '\b(ghp|github_pat)_[A-Za-z0-9_]{20,}\b'),
 ('bearer', '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}'), ('assigned_secret', '(?i)\b(api[_-]?key|access[_-]?token|client[_-]?secret|password|secret)\s*[:=]\s*[''"]?[A-Za-z0-9_./+=-]{16,}')) r(rule, p) WHERE regexp_matches(text, p)"""
)
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.secret_rules(F.col("text"))).alias("rule"))


@query(
    r"""WITH s AS (SELECT doc_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents WHERE title IS NOT NULL)
SELECT doc_id, CASE WHEN s = '' THEN 'untitled' WHEN length(s) > 40 THEN regexp_replace(substr(s, 1, 31), '-+$', '') || '-' || substr(sha1(s), 1, 8) ELSE s END AS slug,
 lower(regexp_replace(regexp_replace(title, '[\\/:*?"<>|\s]+', '-', 'g'), '^[-. ]+|[-. ]+$', '', 'g')) AS file_name FROM s"""
)
def slugs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("title is not null")
    return d.select("doc_id", T.slug(F.col("title"), 40).alias("slug"), T.safe_name(F.col("title")).alias("file_name"))


@query(
    """WITH x AS (SELECT doc_id, coalesce(evidence_kind, '') AS k, n_chars FROM documents)
SELECT tier, count(*) AS documents, sum(n_chars) AS chars FROM (SELECT CASE WHEN k <> '' AND k <> 'body' THEN 'discovery' ELSE 'search' END AS tier, n_chars FROM x) GROUP BY tier"""
)
def source_tiers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.tier_of(F.lit(None).cast("string"), F.lit("web"), F.col("evidence_kind")).alias("tier"), "n_chars")
    return d.groupBy("tier").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query(
    """WITH o AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE n_chars IS NOT NULL)
SELECT source, doc_id, used FROM o WHERE used <= 20000"""
)
def running_budget(spark, sf_dir):
    """Documents of each source, in order, up to the first that exceeds a budget of characters."""
    d = table(spark, sf_dir, "documents").where("n_chars is not null").select("source", "doc_id", "n_chars")
    return search.budget_prefix(d, ["source"], ["doc_id"], F.col("n_chars"), 20_000).select("source", "doc_id", "used")


@query(
    """WITH o AS (SELECT doc_id, source, text, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE text IS NOT NULL)
SELECT source, doc_id, length(substr(text, 1, CAST(60000 - before AS INT))) AS taken FROM o WHERE before < 60000"""
)
def truncated_budget(spark, sf_dir):
    """As ``running_budget``, but the document that exceeds the budget is cut at it."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", "n_chars").withColumn("before", F.coalesce(F.sum("n_chars").over(w), F.lit(0)))
    return d.where("before < 60000").select("source", "doc_id", F.least("n_chars", 60000 - F.col("before")).alias("taken"))


@query("SELECT source, doc_id, lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 5, '0') AS file_index FROM documents")
def file_indexes(spark, sf_dir):
    """Running file numbers in each source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return d.withColumn("file_index", F.lpad(F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("string"), 5, "0"))


# --- pages and URLs --------------------------------------------------------------------------------


@query(
    r"""SELECT fetch_id, CASE WHEN h = '' THEN 'unknown' ELSE regexp_replace(h, '^www\.', '') END AS host, regexp_matches(url, '^https?://') AS safe_scheme, site IS NULL AS site_missing
FROM (SELECT fetch_id, url, site, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM fetch_results)"""
)
def url_hosts(spark, sf_dir):
    f = table(spark, sf_dir, "fetch_results")
    return f.select("fetch_id", U.host_of(F.col("url")).alias("host"), F.col("url").rlike("^https?://").alias("safe_scheme"), F.col("site").isNull().alias("site_missing"))


_KEY = r"""regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)(?:https?:)?//', ''), '^(?:[^/?@]*@)?([^/?]*)', 1)), ':(?:80|443)?$', ''), '^www\.', '')
 || regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)(?:https?:)?//', ''), '^[^/?]*(/[^?]*)?', 1), '/+$', '')
 || coalesce('?' || nullif(list_aggregate(list_sort(list_distinct(list_filter(string_split(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z_]+|gclid|fbclid)(=|$)')))), 'string_agg', '&'), ''), '')"""


@query(f"SELECT page_key, count(*) AS hits, count(DISTINCT url) AS urls, min(hit_id) AS first_hit FROM (SELECT hit_id, url, {_KEY} AS page_key FROM search_hits WHERE url IS NOT NULL) GROUP BY page_key")
def hits_by_page(spark, sf_dir):
    h = table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", "url", U.page_key(F.col("url")).alias("page_key"))
    return h.groupBy("page_key").agg(F.count("*").alias("hits"), F.count_distinct("url").alias("urls"), F.min("hit_id").alias("first_hit"))


@query("SELECT fetch_id, lower(url) LIKE '%youtu.be/%' OR lower(url) LIKE '%youtube.com/watch%' OR lower(url) LIKE '%bilibili.com/video/%' AS is_video, lower(source_engine) IN ('cvpr','arxiv','openalex','crossref','semantic_scholar','scholar') OR lower(url) LIKE '%arxiv.org%' OR lower(url) LIKE '%doi.org%' AS is_paper FROM fetch_results")
def url_kinds(spark, sf_dir):
    u = F.lower("url")
    video = u.contains("youtu.be/") | u.contains("youtube.com/watch") | u.contains("bilibili.com/video/")
    paper = F.lower("source_engine").isin("cvpr", "arxiv", "openalex", "crossref", "semantic_scholar", "scholar") | u.contains("arxiv.org") | u.contains("doi.org")
    return table(spark, sf_dir, "fetch_results").select("fetch_id", video.alias("is_video"), paper.alias("is_paper"))


@query("SELECT fetch_id, pos - 1 AS pos, link FROM (SELECT fetch_id, generate_subscripts(links, 1) AS pos, unnest(links) AS link FROM fetch_results) l WHERE pos <= 2 AND link NOT IN (SELECT url FROM fetch_results WHERE url IS NOT NULL)")
def secondary_links(spark, sf_dir):
    """First two links of each page that were not fetched themselves."""
    f = table(spark, sf_dir, "fetch_results")
    links = f.select("fetch_id", F.posexplode(F.slice("links", 1, 2)).alias("pos", "link")).where("link is not null")
    return links.join(f.select(F.col("url").alias("link")), "link", "left_anti").select("fetch_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query("SELECT h.hit_id, h.url FROM search_hits h WHERE h.url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fetch_results f WHERE f.url = h.url)")
def unstored_hits(spark, sf_dir):
    """Hits whose URL is not stored yet."""
    h, f = table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "fetch_results")
    return h.where("url is not null").select("hit_id", "url").join(f.select("url"), "url", "left_anti").select("hit_id", "url")


@query("SELECT f.fetch_id, count(h.hit_id) AS hits, coalesce(max(h.found_at) <= f.fetched_at, false) AS fetched_after FROM fetch_results f JOIN search_hits h ON h.url = f.url GROUP BY f.fetch_id, f.fetched_at")
def hits_of_pages(spark, sf_dir):
    h, f = table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "fetch_results")
    per_url = h.groupBy("url").agg(F.count("hit_id").alias("hits"), F.max("found_at").alias("last"))
    return f.join(per_url, "url").select("fetch_id", "hits", F.coalesce(F.col("last") <= F.col("fetched_at"), F.lit(False)).alias("fetched_after"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) AS k, min(fetch_id) OVER (PARTITION BY url) AS first_id FROM fetch_results WHERE url IS NOT NULL)
SELECT url, fetch_id, first_id, sha256(markdown) AS content_sha256 FROM r WHERE k = 1"""
)
def source_index(spark, sf_dir):
    """Upsert by URL: the last fetch wins, the first place is kept."""
    f = table(spark, sf_dir, "fetch_results").where("url is not null").withColumn("content_sha256", F.sha2("markdown", 256))
    return f.groupBy("url").agg(F.max_by(F.struct("fetch_id", "content_sha256"), F.struct("fetched_at", "fetch_id")).alias("r"), F.min("fetch_id").alias("first_id")).select("url", "r.fetch_id", "first_id", "r.content_sha256")


# --- search -----------------------------------------------------------------------------------------

_TOK = lambda c: f"list_filter(list_distinct(list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9-]{{2,}}|[一-鿿]{{2,}}'), lambda x: lower(x))), lambda x: x NOT IN {T.TOPIC_STOPWORDS})"
_TOKENS = f"""SELECT *, {_TOK("coalesce(query_text, '')")} AS q, {_TOK("coalesce(title, '') || chr(10) || coalesce(snippet, '') || chr(10) || coalesce(url, '')")} AS t FROM search_hits"""
_SCORED = f"SELECT *, CASE WHEN len(q) = 0 THEN 1.0 WHEN len(t) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / len(q) END AS rel FROM ({_TOKENS})"


def _scored(spark, sf_dir) -> DataFrame:
    h = table(spark, sf_dir, "search_hits")
    return h.withColumn("rel", search.relevance(F.col("query_text"), F.col("title"), F.col("snippet"), F.col("url")))


@query(f"SELECT hit_id, CAST(len(q) AS BIGINT) AS query_tokens, CAST(len(list_intersect(q, t)) AS BIGINT) AS shared FROM ({_TOKENS})")
def relevance_tokens(spark, sf_dir):
    h = table(spark, sf_dir, "search_hits")
    q, t = T.topic_tokens(F.col("query_text")), T.topic_tokens(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in ("title", "snippet", "url"))))
    return h.select("hit_id", F.size(q).cast("bigint").alias("query_tokens"), F.size(F.array_intersect(q, t)).cast("bigint").alias("shared"))


@query(f"SELECT hit_id, topic FROM ({_SCORED}) WHERE rel >= 0.12")
def relevant_hits(spark, sf_dir):
    return _scored(spark, sf_dir).where("rel >= 0.12").select("hit_id", "topic")


@query("SELECT url, hit_id, topic, source_engine FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY call_id, hit_id) AS k FROM search_hits WHERE url IS NOT NULL) WHERE k = 1")
def dedup_first_wins(spark, sf_dir):
    h = table(spark, sf_dir, "search_hits").where("url is not null").select("url", "hit_id", "topic", "source_engine", "call_id")
    return search.first_wins(h, ["url"], ["call_id", "hit_id"]).select("url", "hit_id", "topic", "source_engine")


@query(
    f"""WITH s AS ({_SCORED}), k AS (SELECT *, rel >= 0.12 AS keep FROM s), f AS (SELECT url, min(hit_id) AS first FROM k WHERE keep GROUP BY url)
SELECT source_engine AS engine, count(DISTINCT call_id) AS attempted, count(*) AS hits, count(*) FILTER (NOT keep) AS filtered, count(*) FILTER (keep AND hit_id <> first) AS deduplicated, count(*) FILTER (keep AND hit_id = first) AS retained
FROM k LEFT JOIN f USING (url) GROUP BY source_engine"""
)
def source_funnel(spark, sf_dir):
    """Funnel counters per engine."""
    h = table(spark, sf_dir, "search_hits")
    calls = h.select(F.col("source_engine").alias("engine"), "call_id").distinct().withColumn("failed", F.lit(False))
    hits = h.select(F.col("source_engine").alias("engine"), F.col("url").alias("url_key"), F.col("query_text").alias("query"), "title", "snippet", "url", F.col("hit_id").alias("order"))
    return search.funnel(calls, hits, 0.12).select("engine", "attempted", "hits", "filtered", "deduplicated", "retained")


@query("SELECT engine, sum(hits) AS hits, sum(experts) AS experts FROM (SELECT source_engine AS engine, count(*) AS hits, count(*) FILTER (expert) AS experts FROM search_hits GROUP BY 1 UNION ALL SELECT audit_engine, count(*), count(*) FILTER (expert) FROM search_hits WHERE audit_engine IS NOT NULL GROUP BY 1) GROUP BY engine")
def merged_audits(spark, sf_dir):
    h = table(spark, sf_dir, "search_hits")
    part = lambda c: h.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("engine")).agg(F.count("*").alias("hits"), F.count_if("expert").alias("experts"))
    return search.merged_audits(part("source_engine"), part("audit_engine"))


@query("SELECT count(*) AS hits, count(DISTINCT call_id) AS calls, count(DISTINCT topic) AS topics, count(*) FILTER (expert) AS experts, count(*) FILTER (snippet IS NULL) AS without_snippet FROM search_hits")
def search_totals(spark, sf_dir):
    return table(spark, sf_dir, "search_hits").agg(F.count("*").alias("hits"), F.count_distinct("call_id").alias("calls"), F.count_distinct("topic").alias("topics"), F.count_if("expert").alias("experts"), F.count_if(F.col("snippet").isNull()).alias("without_snippet"))


@query(f"SELECT topic, hit_id, CAST(row AS INT) AS rank FROM (SELECT topic, hit_id, row_number() OVER (PARTITION BY topic ORDER BY expert DESC, rel DESC, hit_id) AS row FROM ({_SCORED})) WHERE row <= 10")
def top_hits(spark, sf_dir):
    """Experts first, then relevance; ten of each topic."""
    rows = _scored(spark, sf_dir).select("topic", "hit_id", "expert", "rel")
    return search.top_per_key(rows, ["topic"], [F.col("expert").desc_nulls_first(), F.col("rel").desc(), "hit_id"], 10).select("topic", "hit_id", "rank")


@query("SELECT q.nationkey AS query_no, e.regionkey AS engine_no, s.sort, p.page, (q.nationkey * 6 + s.i * 2 + p.page) * 5 + e.regionkey AS place FROM (SELECT n_nationkey AS nationkey FROM nation) q, (SELECT r_regionkey AS regionkey FROM region) e, (VALUES (0, 'relevance'), (1, 'date'), (2, 'citations')) s(i, sort), (VALUES (0), (1)) p(page) WHERE (q.nationkey * 6 + s.i * 2 + p.page) * 5 + e.regionkey < 200")
def request_plan(spark, sf_dir):
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_no"))
    e = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("engine_no"))
    return search.request_plan(q, e, ["relevance", "date", "citations"], 2, 200).select("query_no", "engine_no", "sort", "page", "place")


@query(
    """WITH c AS (SELECT topic, call_id, min(found_at) AS started, max(found_at) AS ended, count(*) AS n FROM search_hits GROUP BY topic, call_id)
SELECT topic, count(*) AS calls, sum(n) AS hits, max(n) AS largest, count(*) FILTER (ended > started) AS spread FROM c GROUP BY topic"""
)
def search_calls(spark, sf_dir):
    """Call journal by topic. Calls are grouped first, so a hot topic is spread over its calls."""
    c = table(spark, sf_dir, "search_hits").groupBy("topic", "call_id").agg(F.min("found_at").alias("started"), F.max("found_at").alias("ended"), F.count("*").alias("n"))
    return c.groupBy("topic").agg(F.count("*").alias("calls"), F.sum("n").alias("hits"), F.max("n").alias("largest"), F.count_if(F.col("ended") > F.col("started")).alias("spread"))


@query("SELECT hit_id, CASE WHEN length(t) < 8 OR length(u) < 6 THEN true ELSE len(list_distinct(string_split(replace(u, ' ', ''), ''))) <= 2 AND length(u) > 12 END AS noise FROM (SELECT hit_id, trim(title) AS t, trim(regexp_replace(trim(title), 'https?://\\S+', '', 'g')) AS u FROM search_hits WHERE title IS NOT NULL)")
def social_noise(spark, sf_dir):
    t = F.trim("title")
    u = F.trim(F.regexp_replace(t, r"https?://\S+", ""))
    noise = (F.length(t) < 8) | (F.length(u) < 6) | ((F.size(F.array_distinct(F.split(F.replace(u, F.lit(" "), F.lit("")), ""))) <= 2) & (F.length(u) > 12))
    return table(spark, sf_dir, "search_hits").where("title is not null").select("hit_id", noise.alias("noise"))


# --- evidence graph --------------------------------------------------------------------------------

_LOCATED = """SELECT c.chunk_id, c.claim_no, c.fetch_id, c.claim.quote AS quote, c.claim.topic AS topic, CASE WHEN f.markdown IS NULL THEN -1 ELSE instr(f.markdown, c.claim.quote) - 1 END AS start,
 substr(sha256(coalesce(nullif(f.url, ''), f.markdown)), 1, 16) AS source_id, sha256(substr(sha256(coalesce(nullif(f.url, ''), f.markdown)), 1, 16) || c.claim.quote) AS claim_id
 FROM (SELECT chunk_id, fetch_id, unnest(claims) AS claim, generate_subscripts(claims, 1) - 1 AS claim_no FROM chunk_results) c LEFT JOIN fetch_results f USING (fetch_id) WHERE c.claim.quote IS NOT NULL"""
_FACTS = f"""SELECT claim_id, arg_min(source_id, pos) AS source_id, arg_min(quote, pos) AS quote, arg_min(start, pos) AS start, arg_max_null(topic, pos) AS topic, min(pos) AS pos
 FROM (SELECT *, (chunk_id, claim_no) AS pos FROM ({_LOCATED}) WHERE start >= 0) GROUP BY claim_id"""


def _located(spark, sf_dir) -> DataFrame:
    return evidence.locate_quotes(table(spark, sf_dir, "chunk_results"), table(spark, sf_dir, "fetch_results"))


def _facts(spark, sf_dir) -> DataFrame:
    return evidence.facts_of(_located(spark, sf_dir))


@query(f"SELECT chunk_id, claim_no, start, claim_id FROM ({_LOCATED})")
def verify_quotes(spark, sf_dir):
    return _located(spark, sf_dir).select("chunk_id", F.col("claim_no").cast("bigint").alias("claim_no"), F.col("start").cast("bigint").alias("start"), "claim_id")


@query(f"SELECT chunk_id, count(*) AS claims, count(*) FILTER (start >= 0) AS verified, count(*) FILTER (start < 0) = 0 AS all_verified, count(*) FILTER (start >= 0) > 0 AS any_verified FROM ({_LOCATED}) GROUP BY chunk_id")
def claim_support(spark, sf_dir):
    """Semi-join and all-match checks of claims by chunk."""
    good = F.col("start") >= 0
    return _located(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("claims"), F.count_if(good).alias("verified"), F.bool_and(good).alias("all_verified"), F.bool_or(good).alias("any_verified"))


@query(f"SELECT claim_id, source_id, start, topic FROM ({_FACTS})")
def facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("claim_id", "source_id", F.col("start").cast("bigint").alias("start"), "topic")


_NODES = f"SELECT coalesce(nullif(trim(topic), ''), 'general') AS node, count(*) AS claims, count(DISTINCT source_id) AS sources, min(claim_id) AS first_claim, max(claim_id) AS last_claim, CAST(sum(CAST('0x' || substr(claim_id, 1, 15) AS BIGINT)) AS VARCHAR) || '-' || count(*) AS digest FROM ({_FACTS}) GROUP BY 1"


@query(_NODES)
def topic_graph(spark, sf_dir):
    """Topics with their verified claims and sources: the flagship query."""
    return evidence.topic_nodes(_facts(spark, sf_dir), "general")


@query(f"SELECT 'coverage:' || node AS finding_id, 'high' AS priority, sources FROM ({_NODES}) WHERE sources < 40")
def coverage_gaps(spark, sf_dir):
    return evidence.coverage_gaps(topic_graph(spark, sf_dir), 40)


@query(f"SELECT count(*) FILTER (priority = 'high') AS high, count(*) AS total, CASE WHEN count(*) FILTER (priority = 'high') > 0 OR count(*) > 0 THEN 'CONTINUE' ELSE 'STOP_SUCCESS' END AS verdict FROM (SELECT 'high' AS priority FROM ({_NODES}) WHERE sources < 40)")
def quality_gate(spark, sf_dir):
    return evidence.gate(coverage_gaps(spark, sf_dir))


@query(
    f"""WITH f AS ({_FACTS}), a AS (SELECT * FROM f WHERE start < 1500), b AS (SELECT * FROM f WHERE start >= 500)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.claim_id IS NULL THEN 'new_fact' WHEN b.claim_id IS NULL THEN 'kept' WHEN a.quote = b.quote AND a.source_id = b.source_id THEN 'skipped' ELSE 'conflict' END AS kind FROM a FULL JOIN b ON a.claim_id = b.claim_id) GROUP BY kind"""
)
def graph_merge(spark, sf_dir):
    """Two overlapping graphs (facts from the front and from the back of their pages) merged."""
    f = _facts(spark, sf_dir)
    merged = evidence.merge_facts(f.where("start < 1500"), f.where("start >= 500"))
    return merged.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH f AS ({_FACTS}) SELECT claim_id FROM f WHERE start >= 500 EXCEPT SELECT claim_id FROM f WHERE start < 1500")
def new_claims(spark, sf_dir):
    """Claims that only the second graph has."""
    f = _facts(spark, sf_dir)
    return f.where("start >= 500").select("claim_id").exceptAll(f.where("start < 1500").select("claim_id"))


@query(f"SELECT source_id, row_number() OVER (ORDER BY source_id) AS number, claims FROM (SELECT source_id, count(*) AS claims FROM ({_FACTS}) GROUP BY source_id)")
def citation_numbers(spark, sf_dir):
    """Numbers of the cited sources in order of their ids. The order is made by a range shuffle and
    partition counts, not by one task."""
    cited = _facts(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("claims"))
    # Written once, so that the parts are the same for all that is computed from them.
    ordered = written(cited.repartitionByRange("source_id").withColumn("part", F.spark_partition_id()), "ordered")
    inside = ordered.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("source_id")))
    sizes = inside.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before), "part").select("source_id", (F.col("k") + F.col("before")).alias("number"), "claims")  # one row a partition is broadcast


@query("SELECT fetch_id, chunks, quotes, missing FROM (SELECT fetch_id, count(*) AS chunks, coalesce(sum(len(claims)), 0) AS quotes, count(*) FILTER (claims IS NULL) AS missing FROM chunk_results WHERE fetch_id IS NOT NULL GROUP BY fetch_id) WHERE quotes < 3")
def sparse_pages(spark, sf_dir):
    """Pages with few quotes."""
    c = table(spark, sf_dir, "chunk_results").where("fetch_id is not null")
    g = c.groupBy("fetch_id").agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.when(F.col("claims").isNotNull(), F.size("claims"))), F.lit(0)).alias("quotes"), F.count_if(F.col("claims").isNull()).alias("missing"))
    return g.where("quotes < 3")


@query("SELECT coalesce(c.topic, '') AS topic, count(*) AS claims, count(DISTINCT c.quote) AS quotes FROM (SELECT unnest(claims) AS c FROM chunk_results) GROUP BY 1")
def claims_by_topic(spark, sf_dir):
    c = table(spark, sf_dir, "chunk_results").select(F.explode("claims").alias("c")).select(F.coalesce("c.topic", F.lit("")).alias("topic"), "c.quote")
    return c.groupBy("topic").agg(F.count("*").alias("claims"), F.count_distinct("quote").alias("quotes"))


# --- matching, profiles, transcripts, events ------------------------------------------------------------

_TT = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))"


@query(
    f"""WITH p AS (SELECT doc_id, unnest(t) AS tok, len(t) AS np FROM (SELECT doc_id, {_TT('title')} AS t FROM documents WHERE title IS NOT NULL)),
v AS (SELECT fetch_id, unnest(t) AS tok, len(t) AS nv FROM (SELECT fetch_id, {_TT("regexp_extract(markdown, '(?:^|\\n)# ([^\\n]*)', 1)")} AS t FROM fetch_results)),
b AS (SELECT doc_id, fetch_id, count(*) AS shared, any_value(np) AS np, any_value(nv) AS nv FROM p JOIN v USING (tok) GROUP BY doc_id, fetch_id),
s AS (SELECT *, shared / (np + nv - shared) AS sim FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, fetch_id) AS r FROM s WHERE sim >= 0.7)
SELECT d.doc_id AS paper_id, k.fetch_id AS video_id, k.shared AS shared_tokens FROM (SELECT DISTINCT doc_id FROM documents WHERE title IS NOT NULL) d LEFT JOIN k ON k.doc_id = d.doc_id AND r = 1"""
)
def best_title_match(spark, sf_dir):
    """For each titled document the page of the most similar title."""
    p = table(spark, sf_dir, "documents").where("title is not null").select(F.col("doc_id").alias("paper_id"), "title")
    v = table(spark, sf_dir, "fetch_results").select(F.col("fetch_id").alias("video_id"), F.regexp_extract("markdown", r"(?:^|\n)# ([^\n]*)", 1).alias("video_title"))
    return matching.best_match(p, v, 0.7).select("paper_id", "video_id", "shared_tokens")


@query(
    f"""WITH RECURSIVE c AS (SELECT fetch_id, chunk_id, n, {_TT('c.quote')} AS t FROM (SELECT fetch_id, chunk_id, unnest(claims) AS c, generate_subscripts(claims, 1) - 1 AS n FROM chunk_results WHERE fetch_id IS NOT NULL) WHERE c.quote IS NOT NULL),
s AS (SELECT a.fetch_id AS case_id, printf('%020d-%010d', a.chunk_id, a.n) AS i, printf('%020d-%010d', b.chunk_id, b.n) AS j, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS score
 FROM c a JOIN c b ON a.fetch_id = b.fetch_id AND a.chunk_id < b.chunk_id WHERE len(list_intersect(a.t, b.t)) > 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, i, j) AS k FROM s WHERE score >= 0.5),
r AS (SELECT case_id, k, i, j, score, true AS taken, [i] AS used_i, [j] AS used_j FROM o WHERE k = 1
 UNION ALL SELECT o.case_id, o.k, o.i, o.j, o.score, NOT list_contains(r.used_i, o.i) AND NOT list_contains(r.used_j, o.j),
  CASE WHEN NOT list_contains(r.used_i, o.i) AND NOT list_contains(r.used_j, o.j) THEN list_append(r.used_i, o.i) ELSE r.used_i END, CASE WHEN NOT list_contains(r.used_i, o.i) AND NOT list_contains(r.used_j, o.j) THEN list_append(r.used_j, o.j) ELSE r.used_j END
 FROM r JOIN o ON o.case_id = r.case_id AND o.k = r.k + 1)
SELECT case_id, i, j, score FROM r WHERE taken"""
)
def greedy_claim_match(spark, sf_dir):
    """Claims of neighbouring chunks of a page matched one to one by their token overlap."""
    c = table(spark, sf_dir, "chunk_results").where("fetch_id is not null").select("fetch_id", "chunk_id", F.posexplode("claims").alias("n", "c")).where("c.quote is not null")
    rows = c.select(F.col("fetch_id").alias("case_id"), "chunk_id", F.format_string("%020d-%010d", "chunk_id", "n").alias("id"), T.title_tokens(F.col("c.quote")).alias("t"))
    met = rows.alias("a").join(rows.alias("b"), "case_id").where("a.chunk_id < b.chunk_id and arrays_overlap(a.t, b.t)")
    scored = met.select("case_id", F.col("a.id").alias("i"), F.col("b.id").alias("j"), T.jaccard(F.col("a.t"), F.col("b.t")).alias("score")).where("score >= 0.5")
    return matching.greedy_pairs(scored)


@query("SELECT profile_id, pos AS pos, p.institution AS institution, p.period_from AS period_from, p.period_to AS period_to, greatest(p.period_to - p.period_from, 0) AS years FROM (SELECT profile_id, unnest(timeline) AS p, generate_subscripts(timeline, 1) - 1 AS pos FROM profiles) WHERE trim(p.institution) <> ''")
def timeline_queries(spark, sf_dir):
    """One year-windowed query per node of a profile's timeline that names an institution."""
    t = table(spark, sf_dir, "profiles").select("profile_id", F.posexplode("timeline").alias("pos", "p")).where("trim(p.institution) <> ''")
    return t.select("profile_id", F.col("pos").cast("bigint").alias("pos"), "p.institution", "p.period_from", "p.period_to", F.greatest(F.col("p.period_to") - F.col("p.period_from"), F.lit(0)).alias("years"))


@query(
    """SELECT DISTINCT profile_id, q FROM (
 SELECT profile_id, name AS q FROM profiles WHERE trim(name) <> ''
 UNION ALL SELECT profile_id, name || ' ' || x FROM (SELECT profile_id, name, unnest(list_slice(institutions, 1, 3)) AS x FROM profiles WHERE trim(name) <> '')
 UNION ALL SELECT profile_id, name || ' ' || x FROM (SELECT profile_id, name, unnest(list_slice(research_fields, 1, 3)) AS x FROM profiles WHERE trim(name) <> '')
 UNION ALL SELECT profile_id, name || ' ' || x FROM (SELECT profile_id, name, unnest(list_slice(keywords, 1, 3)) AS x FROM profiles WHERE trim(name) <> '')
 UNION ALL SELECT profile_id, unnest(aliases) FROM profiles) WHERE q IS NOT NULL"""
)
def profile_queries(spark, sf_dir):
    """Search queries of a profile: names, names with institutions, fields and keywords, aliases."""
    p = table(spark, sf_dir, "profiles")
    none = F.array().cast("array<string>")
    named = F.when(F.trim("name") != "", F.concat(F.array("name"), *(F.transform(F.coalesce(F.slice(c, 1, 3), none), lambda x: F.concat(F.col("name"), F.lit(" "), x)) for c in ("institutions", "research_fields", "keywords"))))
    every = F.array_distinct(F.concat(F.coalesce(named, none), F.coalesce("aliases", none)))
    return p.select("profile_id", F.explode(every).alias("q")).where("q is not null")


@query("SELECT profile_id, len(list_filter(institutions, lambda x: trim(x) <> '')) AS institutions, confidence >= 0.7 AND (len(institutions) > 0 OR len(research_fields) > 0) AS can_disambiguate FROM profiles")
def disambiguation_gate(spark, sf_dir):
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return table(spark, sf_dir, "profiles").select(
        "profile_id", F.when(F.col("institutions").isNotNull(), F.size(F.filter("institutions", lambda x: F.trim(x) != ""))).cast("bigint").alias("institutions"), ((F.col("confidence") >= 0.7) & ((n("institutions") > 0) | (n("research_fields") > 0))).alias("can_disambiguate")
    )


@query(
    """WITH s AS (SELECT result_id, elapsed_sec FROM transcribe_results WHERE elapsed_sec IS NOT NULL),
c AS (SELECT result_id, unnest(range(0, CAST(ceil(elapsed_sec / 5.0) AS INT))) AS n, elapsed_sec FROM s)
SELECT result_id, n AS chapter, n * 5.0 AS start_sec, least((n + 1) * 5.0, elapsed_sec) AS end_sec FROM c"""
)
def equal_chapters(spark, sf_dir):
    """Chapters of equal length that cover a recording; the last one is cut at its end."""
    s = table(spark, sf_dir, "transcribe_results").where("elapsed_sec is not null")
    c = s.select("result_id", "elapsed_sec", F.explode(F.expr("filter(sequence(0, cast(ceil(elapsed_sec / 5.0D) as int)), i -> i < ceil(elapsed_sec / 5.0D))")).alias("n"))
    return c.select("result_id", F.col("n").cast("bigint").alias("chapter"), (F.col("n") * 5.0).alias("start_sec"), F.least((F.col("n") + 1) * 5.0, F.col("elapsed_sec")).alias("end_sec"))


@query("SELECT engine_used, count(*) AS n, count(*) FILTER (cached) AS cached, count(*) FILTER (lang_code IS NULL) AS no_language, max(length(transcript)) AS longest FROM transcribe_results GROUP BY engine_used")
def transcription_audit(spark, sf_dir):
    return table(spark, sf_dir, "transcribe_results").groupBy("engine_used").agg(F.count("*").alias("n"), F.count_if("cached").alias("cached"), F.count_if(F.col("lang_code").isNull()).alias("no_language"), F.max(F.length("transcript")).cast("bigint").alias("longest"))


@query("SELECT a.item_id, levenshtein(a.question, b.question) AS distance, greatest(length(a.question), length(b.question)) AS longer FROM eval_items a JOIN eval_items b ON b.item_id = a.item_id + 1")
def error_rates(spark, sf_dir):
    """Parts of the character error rate between neighbouring items."""
    e = table(spark, sf_dir, "eval_items")
    b = e.select((F.col("item_id") - 1).alias("item_id"), F.col("question").alias("other"))
    return e.join(b, "item_id").select("item_id", F.levenshtein("question", "other").cast("bigint").alias("distance"), F.greatest(F.length("question"), F.length("other")).cast("bigint").alias("longer"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND ts > (SELECT max(ts) - INTERVAL 3 DAY FROM events)")
def ttl_latest(spark, sf_dir):
    """Cache lookup: the newest entry of each key while it is younger than three days."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
    return best.join(F.broadcast(last)).where(F.col("ts") > F.col("now") - F.expr("interval 3 days")).select("user_id", "event_id", "event_type")  # one row is broadcast


@query("SELECT event_type, user_id, first_event, CAST(seen AS BIGINT) AS seen FROM (SELECT event_type, user_id, min(event_id) AS first_event, count(*) AS seen FROM events GROUP BY event_type, user_id)")
def first_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("seen"))


@query("SELECT code, count(*) AS n, min(CASE code WHEN 'login' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS priority FROM (SELECT event_type AS code FROM events) GROUP BY code")
def exit_codes(spark, sf_dir):
    """Arbitration of result codes by priority."""
    p = F.when(F.col("event_type") == "login", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"), F.min(p).alias("priority"))


_SHINGLED = lambda k: f"list_distinct(CASE WHEN length(t) < {k} THEN [t] ELSE list_transform(range(1, length(t) - {k - 2}), lambda i: substr(t, i, {k})) END)"
_NORMAL = r"lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')))"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, length(text) AS n, {_NORMAL} AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT min(doc_id) AS id, t FROM d WHERE length(t) >= 200 GROUP BY t), s AS (SELECT id, {_SHINGLED(5)} AS g FROM u), z AS MATERIALIZED (SELECT id, g, len(g) AS n FROM s),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, len(list_intersect(a.g, b.g)) AS x FROM z a JOIN z b ON a.id < b.id AND a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n),
e AS MATERIALIZED (SELECT a, b FROM p WHERE x >= 0.85 * (na + nb - x)), w AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT id, id FROM u),
r AS (SELECT a AS id, b AS reach FROM w UNION SELECT r.id, w.b FROM r JOIN w ON w.a = r.reach), c AS (SELECT id, min(reach) AS component FROM r GROUP BY id),
m AS (SELECT d.doc_id, d.n, c.component FROM d JOIN u ON d.t = u.t JOIN c ON c.id = u.id), win AS (SELECT component, first(doc_id ORDER BY n DESC, doc_id) AS winner_id FROM m GROUP BY component)
SELECT doc_id, winner_id FROM m JOIN win USING (component) UNION ALL SELECT doc_id, doc_id FROM d WHERE length(t) < 200"""
)
def near_dup_winners(spark, sf_dir):
    """Near-duplicate documents: components of similar texts and the longest of each."""
    from sievework.operators.similar_texts import near_duplicate_winners

    return near_duplicate_winners(table(spark, sf_dir, "documents"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Hourly counts by type, run as a stream over the table's folder until its data is used up."""
    import uuid

    from sievework.session import shared_dir
    from sievework.streaming.streams import windowed_counts

    src = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(src.schema).parquet(f"{sf_dir}/events.parquet*")
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    counts = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], delay="3650 days")
    sink = lambda batch, _: batch.write.mode("overwrite").parquet(f"{home}/out")
    run = counts.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- further operators ------------------------------------------------------------------------------


@query("SELECT fetch_id, len(list_distinct(regexp_extract_all(markdown, '\\]\\((https?://[^)\\s]+)\\)', 1))) AS links, len(links) AS listed FROM fetch_results WHERE markdown IS NOT NULL")
def page_links(spark, sf_dir):
    """Links that stand in a page, and those that its fetch listed."""
    f = table(spark, sf_dir, "fetch_results").where("markdown is not null")
    found = F.array_distinct(F.regexp_extract_all("markdown", F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1)))
    return f.select("fetch_id", F.size(found).cast("bigint").alias("links"), F.when(F.col("links").isNotNull(), F.size("links")).cast("bigint").alias("listed"))


@query(
    r"""SELECT reason, count(*) AS hits, count(DISTINCT url) AS urls FROM (SELECT url, CASE WHEN NOT regexp_matches(url, '^(?i)https?:') THEN 'scheme' WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]*@') THEN 'credentials'
 WHEN regexp_matches(lower(url), '[?&#](access_token|api_key|apikey|auth|authorization|key|password|secret|sig|signature|token)=') THEN 'credentials' ELSE 'none' END AS reason FROM search_hits) GROUP BY reason"""
)
def url_safety(spark, sf_dir):
    h = table(spark, sf_dir, "search_hits").select("url", F.coalesce(U.refusal(F.col("url")), F.lit("none")).alias("reason"))
    return h.groupBy("reason").agg(F.count("*").alias("hits"), F.count_distinct("url").alias("urls"))


@query(
    """WITH b AS (SELECT doc_id, unnest(string_split(text, E'\\n\\n')) AS p, unnest(range(len(string_split(text, E'\\n\\n')))) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS paragraphs, sum(length(p) + 2) AS packed_length FROM b GROUP BY doc_id"""
)
def paragraph_packing(spark, sf_dir):
    """Paragraphs packed into pieces; paragraphs and total length must come through."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", evidence.packed_paragraphs(F.col("text")).alias("pieces"))
    parts = F.flatten(F.transform("pieces", lambda p: F.split(p, "\n\n", -1)))
    return d.withColumn("parts", parts).select("doc_id", F.size("parts").cast("bigint").alias("paragraphs"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + F.length(p) + 2).alias("packed_length"))


@query(
    """WITH t AS (SELECT profile_id, unnest(list_concat(coalesce(keywords, []), coalesce(research_fields, []))) AS tag, unnest(range(len(list_concat(coalesce(keywords, []), coalesce(research_fields, []))))) AS i FROM profiles),
f AS (SELECT profile_id, trim(tag) AS tag, i, row_number() OVER (PARTITION BY profile_id, lower(trim(tag)) ORDER BY i) AS k FROM t WHERE trim(tag) <> '')
SELECT p.profile_id, coalesce(string_agg(f.tag, '|' ORDER BY f.i) FILTER (f.tag IS NOT NULL), '') AS tags FROM profiles p LEFT JOIN f ON f.profile_id = p.profile_id AND k = 1 GROUP BY p.profile_id"""
)
def merged_tags(spark, sf_dir):
    return table(spark, sf_dir, "profiles").select("profile_id", F.array_join(evidence.merged_tags(F.col("keywords"), F.col("research_fields")), "|").alias("tags"))


@query("SELECT DISTINCT topic, source_engine FROM search_hits WHERE topic IN (SELECT topic FROM search_hits GROUP BY topic HAVING count(DISTINCT source_engine) >= 5)")
def covered_topics(spark, sf_dir):
    """Engines of the topics that at least five engines contribute to."""
    h = table(spark, sf_dir, "search_hits").select("topic", "source_engine").distinct()
    return h.join(h.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 5").select("topic"), "topic", "left_semi")


@query("SELECT paper_engine, year, count(*) AS n FROM (SELECT source_engine AS paper_engine, TRY_CAST(regexp_extract(coalesce(title, '') || ' ' || coalesce(url, ''), '\\b(20\\d{2})\\b', 1) AS INT) AS year FROM search_hits WHERE lower(source_engine) IN ('cvpr','arxiv','openalex','crossref','semantic_scholar','scholar') AND length(trim(title)) >= 8) GROUP BY ALL")
def paper_candidates(spark, sf_dir):
    """Hits of paper engines by the year in their title or URL."""
    h = table(spark, sf_dir, "search_hits").where(F.lower("source_engine").isin("cvpr", "arxiv", "openalex", "crossref", "semantic_scholar", "scholar") & (F.length(F.trim("title")) >= 8))
    return h.select(F.col("source_engine").alias("paper_engine"), T.year_in(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")))).alias("year")).groupBy("paper_engine", "year").agg(F.count("*").alias("n"))


@query(
    """SELECT c.chunk_id, CASE WHEN f.fetch_id IS NOT NULL THEN 'page' WHEN c.fetch_id IS NOT NULL THEN 'dangling' ELSE 'none' END AS link, coalesce(f.source_engine, c.model_name, '') AS provenance
FROM chunk_results c LEFT JOIN fetch_results f USING (fetch_id)"""
)
def lookup_fallbacks(spark, sf_dir):
    """Provenance of chunks: of their page, else of the model."""
    c, f = table(spark, sf_dir, "chunk_results"), table(spark, sf_dir, "fetch_results").select("fetch_id", "source_engine", F.lit(True).alias("there"))
    link = F.when(F.col("there"), "page").when(F.col("fetch_id").isNotNull(), "dangling").otherwise("none")
    return c.join(f, "fetch_id", "left").select("chunk_id", link.alias("link"), F.coalesce("source_engine", "model_name", F.lit("")).alias("provenance"))


@query("SELECT model_name, count(*) AS chunks, count(DISTINCT fetch_id) AS pages, min(chunk_index) AS first_index, max(chunk_index) AS last_index FROM chunk_results GROUP BY model_name")
def extraction_runs(spark, sf_dir):
    return table(spark, sf_dir, "chunk_results").groupBy("model_name").agg(F.count("*").alias("chunks"), F.count_distinct("fetch_id").alias("pages"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (json_valid(props)) AS with_json FROM events GROUP BY user_id")
def json_props(spark, sf_dir):
    """Rows whose text parses as JSON."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("with_json"))


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {_NORMAL} AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), u AS (SELECT min(id) AS id, t FROM d GROUP BY t),
z AS MATERIALIZED (SELECT id, g, len(g) AS n FROM (SELECT id, {_SHINGLED(7)} AS g FROM u)),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, len(list_intersect(a.g, b.g)) AS x FROM z a JOIN z b ON a.id < b.id AND a.n >= 0.98 * b.n AND b.n >= 0.98 * a.n),
e AS MATERIALIZED (SELECT a, b FROM p WHERE x >= 0.98 * (na + nb - x)), k AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k, earlier FROM (SELECT b AS id, list(a) AS earlier FROM e GROUP BY b)),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS lead, CAST([] AS BIGINT[]) AS led
 UNION ALL SELECT k.k, k.id, coalesce(list_min(list_filter(k.earlier, lambda x: NOT list_contains(r.led, x))), k.id), CASE WHEN list_min(list_filter(k.earlier, lambda x: NOT list_contains(r.led, x))) IS NULL THEN r.led ELSE list_append(r.led, k.id) END FROM r JOIN k ON k.k = r.k + 1)
SELECT d.id, coalesce(r.lead, u.id) AS family FROM d JOIN u ON d.t = u.t LEFT JOIN r ON r.id = u.id"""
)
def content_families(spark, sf_dir):
    """Reprints of one text as families under their first source."""
    from sievework.operators.similar_texts import content_families as families

    return families(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
