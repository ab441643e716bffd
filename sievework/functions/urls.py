"""URLs as columns: the page that a URL addresses, its host, its safety."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the visit.
TRACKING = (
    r"utm_[a-z_]+|gclid|gclsrc|dclid|gbraid|wbraid|fbclid|msclkid|yclid|twclid|ttclid|igshid|igsh|li_fat_id|mc_cid|mc_eid|mkt_tok|_ga|_gl|"
    r"_hsenc|_hsmi|hsctatracking|vero_id|vero_conv|wickedid|oly_anon_id|oly_enc_id|rb_clickid|s_cid|ref_src|spm|cmpid|icid|at_medium|at_campaign"
)


def page_key(url: Column) -> Column:
    """A string that URLs of one page share: without scheme, ``www.``, default port, user, fragment,
    trailing slash and tracking parameters; host in lower case, parameters in order of their text,
    escapes of unreserved characters undone and the others in upper case. Path, other parameters
    and their values keep their letter case. Null stays null; text without a host is itself."""
    clean = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(clean, r"^(?i)(?:https?:)?//", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?$", ""), r"^www\.|\.$", "")
    path = F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1)
    path = F.regexp_replace(path, r"/(?:\./)+|/{2,}", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"/(?:index\.(?:html?|php|aspx?)|default\.(?:html?|aspx?))$", "/"), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "[&;]"), lambda p: (p != "") & ~F.lower(p).rlike(rf"^(?:{TRACKING})(?:=|$)"))
    key = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(F.array_distinct(kept)), "&"))).otherwise(""))
    for code, char in (("2D", "-"), ("2E", "."), ("5F", "_"), ("7E", "~")):
        key = F.regexp_replace(key, rf"(?i)%{code}", char)
    return F.when(url.isNull(), F.lit(None).cast("string")).otherwise(key)


def host_of(url: Column) -> Column:
    """Host in lower case without port and leading ``www.``; 'unknown' where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host == "", F.lit("unknown")).otherwise(F.coalesce(host, F.lit("unknown")))


# Networks whose literal addresses may not be fetched.
BLOCKED_NETWORKS = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.2.0/24",
    "192.88.99.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "::1/128",
    "::/8",
    "fc00::/7",
    "fe80::/10",
    "ff00::/8",
)
# Keys of a query or fragment that carry credentials.
SENSITIVE_KEYS = (
    "access_token",
    "api_key",
    "apikey",
    "auth",
    "authorization",
    "key",
    "password",
    "secret",
    "sig",
    "signature",
    "token",
    "x-amz-credential",
    "x-amz-signature",
    "awsaccesskeyid",
)
SENSITIVE_PART = r"(?:^|[-_.])(api[-_.]?key|auth|credential|password|secret|signature|token)(?:$|[-_.])"


def _prefixes(version: int) -> list[str]:
    """The blocked networks of one version as the leading bits of their addresses."""
    nets = [n for n in map(ip_network, BLOCKED_NETWORKS) if n.version == version]
    return [f"{int(n.network_address):0{n.max_prefixlen}b}"[: n.prefixlen] for n in nets]


def _bits(numbers: Column, width: int) -> Column:
    return F.array_join(F.transform(numbers, lambda n: F.lpad(F.bin(n), width, "0")), "")


def ipv4_bits(host: Column) -> Column:
    """The 32 bits of a literal IPv4 address, null for anything else."""
    literal = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(literal, _bits(F.transform(F.split(host, r"\."), lambda x: x.try_cast("bigint")), 8))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_bits(host: Column) -> Column:
    """The 128 bits of a literal IPv6 address (without brackets; a zone is left out), null for anything
    else. ``::`` stands for as many zero groups as are missing; the last 32 bits may be written as IPv4."""

    def plain(bare: Column) -> Column:
        quad = F.regexp_extract(bare, r"(?:^|:)(\d+\.\d+\.\d+\.\d+)$", 1)
        tail = let(ipv4_bits(quad), lambda bits: F.concat_ws(":", *(F.lower(F.conv(F.substring(bits, s, 16), 2, 16)) for s in (1, 17))))
        return F.when(quad == "", bare).when(ipv4_bits(quad).isNotNull(), F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(quad)), tail))

    def groups(halves: Column) -> Column:
        part = lambda k: F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
        two = F.size(halves) == 2
        return let(F.struct(part(0).alias("l"), part(1).alias("r")), lambda p: let(8 - F.size(p["l"]) - F.size(p["r"]), lambda missing: F.when((F.size(halves) <= 2) & F.when(two, missing >= 1).otherwise(missing == 0), F.concat(p["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), p["r"]))))

    every = let(plain(F.lower(F.regexp_replace(host, "%.*$", ""))), lambda p: F.when(p.rlike("^[0-9a-f:]+$"), groups(F.split(p, "::", -1))))
    return let(every, lambda gs: F.when(F.forall(gs, lambda g: g.rlike("^[0-9a-f]{1,4}$")), _bits(F.transform(gs, lambda g: F.conv(g, 16, 10).cast("bigint")), 16)))


def blocked_address(host: Column) -> Column:
    """Whether a literal address (IPv6 with or without brackets) lies in a blocked network; null for a
    name. An IPv6 address that holds an IPv4 one is judged by its own networks."""
    one_of = lambda version: "^(?:" + "|".join(_prefixes(version)) + ")"

    def judged(h: Column) -> Column:
        v6 = ipv6_bits(F.regexp_replace(h, r"^\[|\]$", ""))
        return F.coalesce(ipv4_bits(h).rlike(one_of(4)), F.when(h.contains(":"), F.coalesce(v6.rlike(one_of(6)), F.lit(True))))

    return let(host, judged)


def _keys_of(part: Column) -> Column:
    return F.transform(F.filter(F.split(part, "&"), lambda p: p != ""), lambda p: F.lower(F.trim(F.regexp_extract(p, "^([^=]*)", 1))))


def refusal(url: Column) -> Column:
    """Why a URL may not be fetched: 'scheme', 'credentials', 'host', 'network', or null when it may.
    Host names are not resolved; answers of a resolver go through the same test as literal URLs."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(F.regexp_replace(rest, "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))
    keys = F.concat(_keys_of(F.regexp_extract(url, r"\?([^#]*)", 1)), _keys_of(F.regexp_extract(url, r"#(.*)$", 1)))
    secret = F.exists(keys, lambda k: k.isin(*SENSITIVE_KEYS) | k.rlike(SENSITIVE_PART))
    return (
        F.when(~scheme.isin("http", "https") | url.isNull(), "scheme")
        .when(rest.contains("@") | secret, "credentials")
        .when(host == "", "host")
        .when(blocked_address(host), "network")
    )


def platform(url: Column) -> Column:
    """Video platform of a URL, or null."""
    u = F.lower(url)
    return F.when(u.rlike(r"^https?://(?:www\.|m\.)?(?:youtube\.com/(?:watch|shorts/)|youtu\.be/)"), "youtube").when(u.rlike(r"^https?://(?:www\.|m\.)?(?:bilibili\.com/video/|b23\.tv/)"), "bilibili")


def video_id(url: Column) -> Column:
    """Id of a video in its URL, '' when there is none."""
    return F.coalesce(*(F.when(F.regexp_extract(url, p, 1) != "", F.regexp_extract(url, p, 1)) for p in (r"[?&]v=([A-Za-z0-9_-]{6,})", r"youtu\.be/([A-Za-z0-9_-]{6,})", r"/shorts/([A-Za-z0-9_-]{6,})", r"/video/(BV[A-Za-z0-9]+|av\d+)")), F.lit(""))
