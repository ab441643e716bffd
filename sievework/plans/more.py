"""Further queries over the test tables: citations, sources, papers, markup, headers, sets of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import urls as U
from sievework.operators import evidence, search
from sievework.plans.catalogue import _FACTS, _LOCATED, _SCORED, _facts, _located, _scored, query
from sievework.session import table


@query(f"SELECT node, row_number() OVER (PARTITION BY node ORDER BY claim_id) AS place, claim_id FROM (SELECT coalesce(nullif(trim(topic), ''), 'general') AS node, claim_id FROM ({_FACTS}))")
def topic_claims(spark, sf_dir):
    """Claims of each topic in order of their ids."""
    return evidence.node_claims(_facts(spark, sf_dir), "general")


_FAMILY = "SELECT DISTINCT substr(sha256(coalesce(nullif(url, ''), markdown)), 1, 16) AS source_id, min(substr(sha256(coalesce(nullif(url, ''), markdown)), 1, 16)) OVER (PARTITION BY markdown) AS family FROM fetch_results WHERE markdown IS NOT NULL"


@query(
    f"""WITH fam AS (SELECT source_id, min(family) AS family FROM ({_FAMILY}) GROUP BY source_id)
SELECT 'coverage:' || node AS finding_id, 'high' AS priority, sources FROM (SELECT coalesce(nullif(trim(topic), ''), 'general') AS node, count(DISTINCT coalesce(family, f.source_id)) AS sources FROM ({_FACTS}) f LEFT JOIN fam ON fam.source_id = f.source_id GROUP BY 1) WHERE sources < 40"""
)
def family_gaps(spark, sf_dir):
    """Topics with too few independent sources, reprints of one text counted once."""
    f = table(spark, sf_dir, "fetch_results").where("markdown is not null").select(T.source_id(F.col("url"), F.col("markdown")).alias("source_id"), F.sha2("markdown", 256).alias("h"))
    least = f.groupBy("h").agg(F.min("source_id").alias("family"))
    families = f.join(least, "h").groupBy("source_id").agg(F.min("family").alias("family"))
    return evidence.coverage_gaps(evidence.topic_nodes(_facts(spark, sf_dir), "general", families), 40)


@query(
    f"""WITH s AS (SELECT source_id, arg_min(url, fetch_id) AS url, arg_min(markdown, fetch_id) AS markdown FROM (SELECT fetch_id, url, markdown, substr(sha256(coalesce(nullif(url, ''), markdown)), 1, 16) AS source_id FROM fetch_results WHERE markdown IS NOT NULL AND fetch_id % 9 <> 0) GROUP BY source_id),
c AS (SELECT l.claim_id, l.source_id, l.quote, l.start + CASE WHEN l.chunk_id % 5 = 0 THEN 1 ELSE 0 END AS a, f.url, sha256(f.markdown) AS h FROM ({_LOCATED}) l JOIN fetch_results f USING (fetch_id) WHERE l.start >= 0)
SELECT coalesce(violation, 'none') AS violation, count(*) AS citations, count(DISTINCT claim_id) AS claims FROM (SELECT c.claim_id, CASE WHEN s.source_id IS NULL THEN 'missing' WHEN c.url IS DISTINCT FROM s.url THEN 'locator' WHEN c.h <> sha256(s.markdown) THEN 'hash' WHEN substr(s.markdown, c.a + 1, length(c.quote)) <> c.quote OR length(trim(c.quote)) = 0 THEN 'span' END AS violation FROM c LEFT JOIN s USING (source_id)) GROUP BY 1"""
)
def citation_check(spark, sf_dir):
    """Citations joined to the sources they name: some sources left out, some offsets moved, and pages
    that have changed since they were cited."""
    f = table(spark, sf_dir, "fetch_results")
    sid = T.source_id(F.col("url"), F.col("markdown"))
    own = f.where("markdown is not null and fetch_id % 9 <> 0").groupBy(sid.alias("source_id")).agg(F.min_by("url", "fetch_id").alias("locator"), F.min_by("markdown", "fetch_id").alias("text"))
    sources = own.withColumn("content_sha256", T.content_hash(F.col("text")))
    start = F.col("start") + F.when(F.col("chunk_id") % 5 == 0, 1).otherwise(0)
    cited = _located(spark, sf_dir).where("start >= 0").join(f.select("fetch_id", "url", T.content_hash(F.col("markdown")).alias("h")), "fetch_id")
    citation = F.struct("source_id", F.col("url").alias("locator"), F.col("h").alias("content_sha256"), start.alias("start_offset"), (start + F.length("quote")).alias("end_offset"), F.col("quote").alias("text"))
    checked = evidence.checked_citations(cited.select("claim_id", F.array(citation).alias("citations")), sources)
    return checked.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("citations"), F.count_distinct("claim_id").alias("claims"))


@query(
    """WITH x AS (SELECT fetch_id, substr(sha256(url), 1, 16) AS source_id, url, sha256(markdown) AS h FROM fetch_results WHERE url IS NOT NULL AND markdown IS NOT NULL),
a AS (SELECT source_id, count(*) AS n, min((url, h)) AS r FROM x WHERE fetch_id % 3 <> 0 GROUP BY source_id), b AS (SELECT source_id, count(DISTINCT (url, h)) AS m, min((url, h)) AS r FROM x WHERE fetch_id % 3 <> 1 GROUP BY source_id)
SELECT source_id, CASE WHEN n > 1 OR m > 1 THEN 'conflict' WHEN n IS NULL THEN 'new' WHEN m IS NULL THEN 'kept' WHEN a.r = b.r THEN 'same' ELSE 'conflict' END AS kind FROM a FULL JOIN b USING (source_id)"""
)
def source_merge(spark, sf_dir):
    """Two overlapping sets of sources merged: new, kept, same, in conflict."""
    f = table(spark, sf_dir, "fetch_results").where("url is not null and markdown is not null")
    x = f.select("fetch_id", F.substring(F.sha2("url", 256), 1, 16).alias("source_id"), F.col("url").alias("locator"), T.content_hash(F.col("markdown")).alias("content_sha256"))
    return evidence.merge_sources(x.where("fetch_id % 3 <> 0").drop("fetch_id"), x.where("fetch_id % 3 <> 1").drop("fetch_id")).select("source_id", "kind")


@query(
    f"""WITH l AS ({_LOCATED}), e AS (SELECT claim_id, count(*) AS expected FROM ({_FACTS}) GROUP BY claim_id), p AS (SELECT claim_id, count(*) AS placed FROM l GROUP BY claim_id)
SELECT claim_id, coalesce(expected, 0) AS expected, coalesce(placed, 0) AS placed FROM e FULL JOIN p USING (claim_id) WHERE coalesce(expected, 0) = 0 OR coalesce(placed, 0) <> 1"""
)
def section_cover(spark, sf_dir):
    """Facts that do not stand exactly once among the claims of all sections."""
    located = _located(spark, sf_dir).select("claim_id")
    return evidence.exact_cover(_facts(spark, sf_dir).select("claim_id"), located, "claim_id").select("claim_id", "expected", "placed")


# --- markup and headers ------------------------------------------------------------------------------


@query(
    r"""SELECT hit_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(snippet, '<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|blockquote)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&middot;', '·'), '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '', '')) AS plain FROM search_hits WHERE snippet IS NOT NULL"""
)
def snippet_text(spark, sf_dir):
    """Snippets as plain text, markup and character references undone."""
    return table(spark, sf_dir, "search_hits").where("snippet is not null").select("hit_id", T.html_text(F.col("snippet")).alias("plain"))


@query("SELECT doc_id, '<&>\" ' || chr(CAST(9000 + doc_id % 500 AS INT)) || chr(CAST(9000 + doc_id % 500 AS INT)) || ' é &nosuch;' AS plain FROM documents")
def character_references(spark, sf_dir):
    """Named, decimal and hexadecimal references of characters."""
    n = F.lit(9000) + F.col("doc_id") % 500
    made = F.concat(F.lit("&lt;&amp;&gt;&quot; &#"), n.cast("string"), F.lit(";&#x"), F.hex(n), F.lit("; &eacute; &nosuch;"))
    return table(spark, sf_dir, "documents").select("doc_id", T.unescape(made).alias("plain"))


@query("SELECT doc_id, title, CASE WHEN trim(source) = '' THEN NULL ELSE source END AS source, sha256(text) AS body_sha256, title IS NOT NULL AS has_header FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND NOT starts_with(text, '---')")
def front_matter(spark, sf_dir):
    """Headers between rules written and read again; texts without title get none."""
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null and not startswith(text, '---')")
    made = F.when(F.col("title").isNotNull(), F.concat(F.lit('---\ntitle: "'), "title", F.lit('"\nsource: '), "source", F.lit("\nsource: again\n---\n"), "text")).otherwise(F.col("text"))
    parsed = d.select("doc_id", "source", F.col("title").isNotNull().alias("has_header"), T.front_matter(made).alias("f"))
    # Where there is no header the source is the table's.
    return parsed.select("doc_id", F.try_element_at("f.meta", F.lit("title")).alias("title"), F.when(F.col("has_header"), F.try_element_at("f.meta", F.lit("source"))).otherwise(F.col("source")).alias("source"), T.content_hash(F.col("f.body")).alias("body_sha256"), "has_header")


@query(
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(regexp_extract(text, '^((?:[ \t]*<!--[^\n]*-->[ \t]*\n?)*)', 1), '<!--\s*title:\s*(.*?)\s*-->', 1), ''), nullif(regexp_extract(b, '(?m)^#{1,6}[ \t]+([^\n]+?)[ \t]*$', 1), '')) AS title, substr(trim(regexp_replace(b, '[ \t\r\n\f]+', ' ', 'g')), 1, 200) AS excerpt
FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '^(?:[ \t]*<!--[^\n]*-->[ \t]*(?:\n|$))+', ''), '^[\r\n]+', '') AS b FROM documents WHERE text IS NOT NULL)"""
)
def title_excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.title_and_excerpt(F.col("text")).alias("t"))
    return d.select("doc_id", "t.title", "t.excerpt")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def noisy_json(spark, sf_dir):
    """First JSON value of a noisy line that has a bracket before it."""
    made = F.concat(F.lit("info [x] {"), F.lit("broken "), "props", F.lit(" trailing } ]"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(T.first_json(made), "$.k", "bigint").alias("k"))


@query(
    """SELECT result_id, CAST(floor(elapsed_sec * 37) AS BIGINT) AS seconds,
CASE WHEN floor(elapsed_sec * 37) >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(floor(elapsed_sec * 37) / 3600) AS INT), CAST(floor(floor(elapsed_sec * 37) % 3600 / 60) AS INT), CAST(floor(elapsed_sec * 37) % 60 AS INT)) ELSE printf('%d:%02d', CAST(floor(floor(elapsed_sec * 37) / 60) AS INT), CAST(floor(elapsed_sec * 37) % 60 AS INT)) END AS written
FROM transcribe_results WHERE elapsed_sec >= 0"""
)
def durations(spark, sf_dir):
    """Durations written and read again."""
    s = F.floor(F.col("elapsed_sec") * 37).cast("bigint")
    d = table(spark, sf_dir, "transcribe_results").where("elapsed_sec >= 0").select("result_id", T.duration_text(s).alias("written"))
    return d.select("result_id", T.duration_seconds(F.col("written")).alias("seconds"), "written")


@query("SELECT profile_id, CAST(len(list_filter(list_transform(string_split(coalesce(name, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS parts, array_to_string(list_filter(list_transform(string_split(coalesce(name, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS joined FROM profiles")
def comma_lists(spark, sf_dir):
    parts = T.comma_list(F.col("name"))
    return table(spark, sf_dir, "profiles").select("profile_id", F.size(parts).cast("bigint").alias("parts"), F.array_join(parts, "|").alias("joined"))


@query(
    r"""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 1 THEN 'use sk-proj-' || sha256(text) || ' now' WHEN 2 THEN 'ghp_' || substr(sha256(text), 1, 36) WHEN 3 THEN 'Bearer ' || sha256(text) WHEN 4 THEN 'client_secret = "' || substr(sha256(text), 1, 20) || '"' ELSE 'password: short' END AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, rule FROM d, (VALUES ('private_key', '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----'), ('openai', '\bsk-(proj-|ant-)?[A-Za-z0-9_-]{20,}\b'), ('github', '\b(ghp|github_pat)_[A-Za-z0-9_]{20,}\b'), ('bearer', '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}'), ('assigned_secret', '(?i)\b(api[_-]?key|access[_-]?token|client[_-]?secret|password|secret)\s*[:=]\s*[''"]?[A-Za-z0-9_./+=-]{16,}')) r(rule, p) WHERE regexp_matches(t, p)"""
)
def planted_secrets(spark, sf_dir):
    """Every rule of the secret scan on texts that hold such a secret, and on one that does not."""
    h = F.sha2("text", 256)
    k = F.col("doc_id") % 6
    made = (
        F.when(k == 0, "-----BEGIN RSA PRIVATE KEY-----").when(k == 1, F.concat(F.lit("use sk-proj-"), h, F.lit(" now"))).when(k == 2, F.concat(F.lit("ghp_"), F.substring(h, 1, 36)))
        .when(k == 3, F.concat(F.lit("Bearer "), h)).when(k == 4, F.concat(F.lit('client_secret = "'), F.substring(h, 1, 20), F.lit('"'))).otherwise("password: short")
    )
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(T.secret_rules(made)).alias("rule"))


_V4 = "(CAST(a AS BIGINT) * 16777216 + CAST(b AS BIGINT) * 65536 + c * 256 + d)"


@query(
    f"""WITH e AS (SELECT event_id, event_id * 7919 % 256 AS a, event_id * 104729 % 256 AS b, event_id * 31 % 256 AS c, event_id % 256 AS d, event_id * 613 % 65536 AS g FROM events)
SELECT event_id, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR (b = 0 AND c = 2) OR (b = 88 AND c = 99))) OR (a = 198 AND b IN (18, 19)) AS v4_blocked,
 g < 256 OR g BETWEEN 64512 AND 65023 OR g BETWEEN 65152 AND 65215 OR g >= 65280 AS v6_blocked, g >= 256 AND NOT (g BETWEEN 64512 AND 65023 OR g BETWEEN 65152 AND 65215 OR g >= 65280) AS v6_short_open FROM e"""
)
def url_literals(spark, sf_dir):
    """Literal addresses of both versions against the blocked networks, IPv6 written out and shortened."""
    e = table(spark, sf_dir, "events")
    part = lambda x: (x % 256).cast("string")
    v4 = F.concat_ws(".", part(F.col("event_id") * 7919), part(F.col("event_id") * 104729), part(F.col("event_id") * 31), part(F.col("event_id")))
    g = F.lower(F.hex(F.col("event_id") * 613 % 65536))
    reason = lambda host: U.refusal(F.concat(F.lit("http://"), host, F.lit("/x")))
    long = F.concat(F.lit("["), g, F.lit(":1:2:3:4:5:6:7]"))
    return e.select("event_id", reason(v4).isNotNull().alias("v4_blocked"), reason(long).isNotNull().alias("v6_blocked"), reason(F.concat(F.lit("["), g, F.lit("::1]"))).isNull().alias("v6_short_open"))


@query("SELECT hit_id, regexp_replace(url, '([?&](?:id|sec)=)[^&#]*', '\\1***', 'g') AS shown FROM search_hits WHERE url IS NOT NULL")
def redacted_urls(spark, sf_dir):
    """Values of given parameters hidden in URLs."""
    return table(spark, sf_dir, "search_hits").where("url is not null").select("hit_id", F.regexp_replace("url", r"([?&](?:id|sec)=)[^&#]*", "$1***").alias("shown"))


# --- papers, calls, sets of files ----------------------------------------------------------------------

_PAPER_ENGINES = ("cvpr", "arxiv", "openalex", "crossref", "semantic_scholar", "scholar")


@query(
    f"""SELECT key, hit_id, year, engine = 'cvpr' AS preferred, title || CASE WHEN engine = '' THEN '' ELSE ' ' || engine END || coalesce(' ' || year, '') AS talk_query FROM (SELECT lower(trim(title)) AS key, hit_id, trim(title) AS title, lower(coalesce(source_engine, '')) AS engine, coalesce(TRY_CAST(nullif(regexp_extract(snippet, '\\b(20\\d{{2}})\\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(url, '\\b(20\\d{{2}})\\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(title, '\\b(20\\d{{2}})\\b', 1), '') AS INT)) AS year,
 row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY hit_id) AS k FROM search_hits WHERE length(trim(title)) >= 8 AND lower(source_engine) IN {_PAPER_ENGINES}) WHERE k = 1"""
)
def paper_list(spark, sf_dir):
    """Papers among the hits, first of each title, with their year and the query for a talk."""
    h = table(spark, sf_dir, "search_hits").where((F.length(F.trim("title")) >= 8) & F.lower("source_engine").isin(*_PAPER_ENGINES))
    rows = h.select(F.lower(F.trim("title")).alias("key"), "hit_id", F.trim("title").alias("title"), F.lower("source_engine").alias("engine"), T.year_in(F.col("snippet"), F.col("url"), F.col("title")).alias("year"))
    return search.first_wins(rows, ["key"], ["hit_id"]).select("key", "hit_id", "year", (F.col("engine") == "cvpr").alias("preferred"), F.concat_ws(" ", "title", F.when(F.col("engine") != "", F.col("engine")), F.col("year").cast("string")).alias("talk_query"))


@query(
    f"""SELECT topic, hit_id, rel >= 0.12 AS matched FROM (SELECT topic, hit_id, rel, coalesce(sum(CASE WHEN rel >= 0.12 THEN 1 ELSE 0 END) OVER (PARTITION BY topic ORDER BY hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_SCORED})) WHERE before < 2"""
)
def take_until_matched(spark, sf_dir):
    """Hits of each topic in order until two have matched."""
    rows = _scored(spark, sf_dir).select("topic", "hit_id", (F.col("rel") >= 0.12).alias("matched"))
    return search.take_until(rows, ["topic"], "hit_id", F.col("matched"), 2)


@query(
    """WITH c AS (SELECT topic, source_engine AS engine, count(DISTINCT call_id) AS calls, count(*) AS hits, count(DISTINCT url) AS pages, count(audit_engine) AS audited FROM search_hits GROUP BY topic, source_engine)
SELECT topic, count(*) AS engines, string_agg(engine, ', ' ORDER BY engine) AS names, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(pages) AS BIGINT) AS pages, count(*) FILTER (audited > 0) AS audited_engines FROM c GROUP BY topic"""
)
def engine_coverage(spark, sf_dir):
    """Engines that each topic's calls reached, with their sums; engines are a small set."""
    h = table(spark, sf_dir, "search_hits")
    c = h.groupBy("topic", F.col("source_engine").alias("engine")).agg(F.count_distinct("call_id").alias("calls"), F.count("*").alias("hits"), F.count_distinct("url").alias("pages"), F.count("audit_engine").alias("audited"))
    return c.groupBy("topic").agg(F.count("*").alias("engines"), F.array_join(F.array_sort(F.collect_set("engine")), ", ").alias("names"), F.sum("calls").alias("calls"), F.sum("hits").alias("hits"), F.sum("pages").alias("pages"), F.count_if(F.col("audited") > 0).alias("audited_engines"))


@query(
    """SELECT key, first_profile, first_place, spelling, role FROM (SELECT lower(trim(p.institution)) AS key, profile_id AS first_profile, pos AS first_place, p.institution AS spelling, p.role_title AS role, row_number() OVER (PARTITION BY lower(trim(p.institution)) ORDER BY profile_id, pos) AS k
FROM (SELECT profile_id, unnest(timeline) AS p, generate_subscripts(timeline, 1) - 1 AS pos FROM profiles)  WHERE trim(p.institution) <> '') WHERE k = 1"""
)
def entity_list(spark, sf_dir):
    """Entities by their natural key, the first mention of each kept."""
    t = table(spark, sf_dir, "profiles").select("profile_id", F.posexplode("timeline").alias("pos", "p")).where("trim(p.institution) <> ''")
    rows = t.select(F.lower(F.trim("p.institution")).alias("key"), F.col("profile_id").alias("first_profile"), F.col("pos").cast("bigint").alias("first_place"), F.col("p.institution").alias("spelling"), F.col("p.role_title").alias("role"))
    return search.first_wins(rows, ["key"], ["first_profile", "first_place"])


@query("SELECT kind, name, count(*) AS uses FROM (SELECT 'role' AS kind, p.role_title AS name FROM (SELECT unnest(timeline) AS p FROM profiles) UNION ALL SELECT 'topic', c.topic FROM (SELECT unnest(claims) AS c FROM chunk_results)) WHERE name IS NOT NULL AND trim(name) <> '' GROUP BY kind, name")
def type_schema(spark, sf_dir):
    """Distinct types of entities and relations with their uses."""
    roles = table(spark, sf_dir, "profiles").select(F.explode("timeline").alias("p")).select(F.lit("role").alias("kind"), F.col("p.role_title").alias("name"))
    topics = table(spark, sf_dir, "chunk_results").select(F.explode("claims").alias("c")).select(F.lit("topic").alias("kind"), F.col("c.topic").alias("name"))
    return roles.unionByName(topics).where("trim(name) <> ''").groupBy("kind", "name").agg(F.count("*").alias("uses"))


@query(
    """WITH x AS (SELECT fetch_id, url, sha256(markdown) AS h FROM fetch_results WHERE url IS NOT NULL AND markdown IS NOT NULL), a AS (SELECT url AS path, min(h) AS h FROM x WHERE fetch_id % 4 <> 0 GROUP BY url), b AS (SELECT url AS path, min(h) AS h FROM x WHERE fetch_id % 4 <> 1 GROUP BY url)
SELECT path, CASE WHEN a.h IS NULL THEN 'extra' WHEN b.h IS NULL THEN 'missing' ELSE 'changed' END AS difference FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h"""
)
def file_set_difference(spark, sf_dir):
    """Files of a manifest against files that are there: missing, extra, changed."""
    x = table(spark, sf_dir, "fetch_results").where("url is not null and markdown is not null").select("fetch_id", F.col("url").alias("path"), T.content_hash(F.col("markdown")).alias("h"))
    part = lambda rest: x.where(rest).groupBy("path").agg(F.min("h").alias("h"))
    return evidence.set_difference(part("fetch_id % 4 <> 0"), part("fetch_id % 4 <> 1"), "path", "h")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS seen FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY user_id")
def as_of_history(spark, sf_dir):
    """The last entry of each key up to a point in time."""
    e = table(spark, sf_dir, "events")
    half = e.agg(F.timestamp_micros(((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2).cast("bigint")).alias("as_of"))
    past = e.join(F.broadcast(half)).where(F.col("ts").cast("timestamp") <= F.col("as_of"))  # one row is broadcast
    return past.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("seen"))


@query("SELECT h.hit_id, f.fetch_id FROM search_hits h LEFT JOIN (SELECT k, max(fetch_id) AS fetch_id FROM (SELECT fetch_id, unnest([url, substr(sha256(url), 1, 16)]) AS k FROM fetch_results WHERE url IS NOT NULL) GROUP BY k) f ON f.k = h.url")
def source_lookup(spark, sf_dir):
    """Sources found by any of their names, the last entry of a name winning."""
    f = table(spark, sf_dir, "fetch_results").where("url is not null").select("fetch_id", F.explode(F.array("url", F.substring(F.sha2("url", 256), 1, 16))).alias("k"))
    last = f.groupBy("k").agg(F.max("fetch_id").alias("fetch_id"))
    h = table(spark, sf_dir, "search_hits").select("hit_id", F.col("url").alias("k"))
    return h.join(last, "k", "left").select("hit_id", "fetch_id")
