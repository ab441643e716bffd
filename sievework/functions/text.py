"""Text as columns: lines, headers, tokens, identities. Expressions run inside the JVM; only the search for
JSON in noise goes through Arrow."""

from __future__ import annotations

import html.entities
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the line filters.
AD_WORDS = r"(?i)\b(advertisement|sponsored|promoted|ad[_\-]?block|adsbygoogle)\b"
TAIL_HEADING = r"(?i)^\s*#{1,6}\s*(Contributing|License|References|参考文献|致谢|License & Credits)\b"
LINK_LINE = r"^\s*[-*]?\s*\[[^\]]*\]\([^)]*\)\s*$|^\s*https?://\S+\s*$"
META_LINE = r"^\s*<!--.*-->\s*$"
SENTENCE_MARK = r"[.!?。！？]"
SHORT_LINE, MENU_RUN, MENU_SHARE, CONTENT_LENGTH, MAX_CONTENT = 40, 3, 0.7, 120, 50_000
HTML_BLOCKS = ("script", "style", "noscript", "nav", "footer", "form", "header", "aside")
# Stop words of the relevance tokens.
TOPIC_STOPWORDS = ("the", "and", "for", "with", "from", "into", "using", "review", "survey", "study", "paper", "application", "applications", "model", "models", "large", "language")
# Patterns of secrets, by rule.
SECRET_RULES = {
    "private_key": r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "openai": r"\bsk-(proj-|ant-)?[A-Za-z0-9_-]{20,}\b",
    "github": r"\b(ghp|github_pat)_[A-Za-z0-9_]{20,}\b",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}",
    "assigned_secret": r"(?i)\b(api[_-]?key|access[_-]?token|client[_-]?secret|password|secret)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{16,}",
}
STRIP = r"^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, STRIP, "")


def lines_of(text: Column) -> Column:
    """Lines, split at every line separator; a final empty line is dropped."""
    parts = F.split(text, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def header_length(lines: Column) -> Column:
    """How many of the first lines are comment headers."""
    return F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x.rlike(META_LINE), 1).otherwise(0)).alias("n"), (s["on"] & x.rlike(META_LINE)).alias("on")), lambda s: s["n"])


def header_value(text: Column, key: str) -> Column:
    """Value of a comment header ``<!-- key: value -->`` among the first lines; null when absent."""
    head = F.regexp_extract(text, r"^((?:[ \t]*<!--[^\n]*-->[ \t]*\n?)*)", 1)
    found = F.regexp_extract(head, rf"<!--\s*{key}:\s*(.*?)\s*-->", 1)
    return F.when(found != "", found)


def body_of(text: Column) -> Column:
    """Text after its comment headers, without leading line breaks."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?:[ \t]*<!--[^\n]*-->[ \t]*(?:\n|$))+", ""), r"^[\r\n]+", "")


def looks_binary(text: Column, sample: int = 4000) -> Column:
    """Remains of a binary file: PDF marks, or over 15 % replacement and control characters."""
    s = F.substring(text, 1, sample)
    bad = F.length(s) - F.length(F.regexp_replace(s, r"[\x{fffd}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]", ""))
    return (F.length(s) > 0) & (F.substring(s, 1, 200).contains("%PDF") | s.contains("FlateDecode") | s.contains("/Filter") | (bad > F.lit(0.15) * F.length(s)))


def strip_html(text: Column) -> Column:
    """Without blocks that hold no content, then without tags. Entities stay; see :func:`unescape`."""
    for tag in HTML_BLOCKS:
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(text, r"<[^>]+>", "")


def unescape(text: Column) -> Column:
    """Character references, by number or by a name of HTML 4, as characters; unknown ones stay. Each
    distinct reference of a text is replaced once, ampersands last."""
    names = F.create_map(*(F.lit(x) for name, code in html.entities.name2codepoint.items() for x in (name, chr(code))))
    char = lambda number: F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")

    def meant(ref):
        body = F.regexp_replace(ref, "^&|;$", "")
        digits = F.regexp_extract(body, "^#([0-9]{1,7})$", 1)
        hexes = F.regexp_extract(body, "^#[xX]([0-9A-Fa-f]{1,6})$", 1)
        number = F.when(digits != "", digits.cast("bigint")).when(hexes != "", F.conv(hexes, 16, 10).cast("bigint"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(valid, char(number)).otherwise(F.coalesce(F.try_element_at(names, body), ref))

    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"), F.lit(0))))
    last = F.array(F.lit("&amp;"), F.lit("&#38;"), F.lit("&#x26;"))
    order = F.concat(F.array_except(refs, last), F.array_intersect(refs, last))
    return F.when(text.contains("&"), F.aggregate(order, text, lambda t, ref: F.replace(t, ref, meant(ref)))).otherwise(text)


def html_text(text: Column) -> Column:
    """HTML as plain text: blocks without content dropped, ends of block elements as line breaks, other
    tags gone, references undone, white space of a line as one space, at most one blank line."""
    for tag in HTML_BLOCKS[:3]:
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|blockquote)>", "\n")
    text = unescape(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_link_line(line: Column) -> Column:
    return line.rlike(LINK_LINE)


def topic_tokens(text: Column) -> Column:
    """Distinct tokens for relevance: Latin words of three characters or more, CJK runs of two."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9-]{2,}|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*map(F.lit, TOPIC_STOPWORDS)))


def title_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits; hyphens and underscores separate."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def source_id(locator: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(F.when(locator != "", locator), text), 256), 1, 16)


def claim_id(source: Column, quote: Column) -> Column:
    return F.sha2(F.concat(source, quote), 256)


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case letters and digits joined by hyphens; a long one ends in a hash of itself."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.concat(F.regexp_replace(F.substring(s, 1, max(most - 9, 8)), "-+$", ""), F.lit("-"), F.substring(F.sha1(s), 1, 8))
    return F.when(s == "", F.lit("untitled")).when(F.length(s) > most, short).otherwise(s)


def safe_name(text: Column) -> Column:
    """File name without characters that file systems refuse."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\s]+', "-"), r"^[-. ]+|[-. ]+$", ""))


def word_count(text: Column) -> Column:
    """CJK characters plus Latin words."""
    return F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")) + F.regexp_count(text, F.lit(r"[A-Za-z]+"))


def secret_rules(text: Column) -> Column:
    """Names of the secret patterns that a text matches."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in SECRET_RULES.items())), lambda x: x.isNotNull())


def redact(text: Column) -> Column:
    """Keys, bearer tokens and passwords in URLs replaced."""
    hidden = "***REDACTED***"
    t = F.regexp_replace(text, r"(?<![A-Za-z0-9])sk-[A-Za-z0-9._-]{8,}", hidden)
    t = F.regexp_replace(t, r"(?i)(authorization\s*:\s*bearer\s+)\S+", "$1" + hidden)
    return F.regexp_replace(t, r"(?i)(https?://[^:@/\s]+:)[^@/\s]+(@)", "$1" + hidden + "$2")


def year_in(*texts: Column) -> Column:
    """First year 20xx of the first text that has one."""
    return F.coalesce(*(F.when(F.regexp_extract(t, r"\b(20\d{2})\b", 1) != "", F.regexp_extract(t, r"\b(20\d{2})\b", 1).cast("int")) for t in texts))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``s``, ``m:ss`` or ``h:mm:ss``; null for anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s * 60 + p)
    return F.when(F.trim(text).rlike(r"^\d{1,6}(?::[0-5]?\d){0,2}$"), total)


def comma_list(text: Column) -> Column:
    """Entries of a comma list, trimmed, empty ones left out; null is an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


FRONT_MATTER = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)\z"


def front_matter(text: Column) -> Column:
    """``meta`` (map of the plain ``key: value`` lines of the header between two rules, quotes taken
    off, the first of equal keys) and ``body`` of a text; a text without a header is all body."""
    head = F.regexp_extract(text, FRONT_MATTER, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)), "^(['\"])(.*)\\1$", "$2").alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.struct(F.map_from_entries(first).alias("meta"), F.when(text.rlike(FRONT_MATTER), F.regexp_extract(text, FRONT_MATTER, 2)).otherwise(text).alias("body"))


def title_and_excerpt(text: Column, most: int = 200) -> Column:
    """``title`` of the header, else of the first heading, else null, and the first ``most`` characters
    of the body as ``excerpt``, white space runs as one space."""
    body = body_of(text)
    heading = F.regexp_extract(body, r"(?m)^#{1,6}[ \t]+([^\n]+?)[ \t]*$", 1)
    return F.struct(F.coalesce(header_value(text, "title"), F.when(heading != "", heading)).alias("title"), F.substring(F.trim(F.regexp_replace(body, r"[ \t\r\n\f]+", " ")), 1, most).alias("excerpt"))


def duration_text(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``; null and negative give ''."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    long, short = F.format_string("%d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int")), F.format_string("%d:%02d", m.cast("int"), s.cast("int"))
    return F.when(seconds.isNull() | (seconds < 0), F.lit("")).when(seconds >= 3600, long).otherwise(short)


def error_rate(heard: Column, said: Column) -> Column:
    """Character error rate: edit distance over the longer length; an empty reference gives 0."""
    return F.when(F.length(said) == 0, F.lit(0.0)).otherwise(F.levenshtein(heard, said) / F.greatest(F.length(heard), F.length(said)))


def _json_in(text: str | None) -> str | None:
    read, at = json.JSONDecoder(parse_constant=lambda c: None).raw_decode, -1
    while text:
        at = min((k for k in (text.find("{", at + 1), text.find("[", at + 1)) if k >= 0), default=-1)
        if at < 0:
            return None
        try:
            return json.dumps(read(text, at)[0], ensure_ascii=False)
        except (ValueError, RecursionError):
            continue
    return None


def first_json(text: Column) -> Column:
    """First JSON object or array in noisy output, as a variant: each opening bracket is tried in turn.
    Null where none parses and for null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_json_in)

    return F.try_parse_json(F.pandas_udf(run, "string")(text))


def answer_json(text: Column) -> Column:
    """A model's reply without its reasoning block, from the first brace to the last."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))


def normalized(text: Column) -> Column:
    """White space runs as one space, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}]+", " ")))


def tier_of(explicit: Column, engine: Column, evidence_kind: Column) -> Column:
    e = F.lower(F.coalesce(engine, F.lit("")))
    return (
        F.when(F.coalesce(explicit, F.lit("")) != "", explicit)
        .when(e == "official", "official")
        .when(e.isin("expert_seed", "expert", "curated"), "curated")
        .when(e == "secondary", "secondary")
        .when(F.coalesce(F.when(evidence_kind != "", evidence_kind), F.lit("body")) != "body", "discovery")
        .otherwise("search")
    )


def version_key(version: Column) -> Column:
    """Sort key of a dotted version: its first three numbers; text that has none sorts by itself."""
    parts = F.transform(F.slice(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), 1, 3), lambda p: F.lpad(p, 12, "0"))
    return F.when(F.size(parts) == 0, version).otherwise(F.array_join(F.concat(parts, F.array_repeat(F.lit("0" * 12), 3 - F.size(parts))), "."))


def bare_hash(value: Column) -> Column:
    """64 hexadecimal digits of a hash with or without ``sha256:`` before them; an error otherwise."""
    found = F.regexp_extract(F.lower(F.trim(value)), r"^(?:sha256:)?([0-9a-f]{64})$", 1)
    return F.when(value.isNull(), F.lit(None)).when(found == "", F.raise_error(F.concat(F.lit("not a SHA-256 hash: "), value))).otherwise(found)


def stage_status(stage: Column, completed: Column, skipped: Column) -> Column:
    return F.when(F.array_contains(completed, stage), "completed").when(F.array_contains(skipped, stage), "skipped").otherwise("not_completed")


def frame_times(duration: Column, count: int) -> Column:
    """Times of ``count`` frames spread over a duration, at least half a second apart."""
    step = F.greatest(duration / count, F.lit(0.5))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(i * step, 3)), lambda t: t < duration)
