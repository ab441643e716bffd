"""Line analysis of Markdown pages and the density tree that finds a page's main body.

Pure Python on one page at a time; the Spark side is in :mod:`sievework.llm.pages`. No phrase of site
furniture is listed here: what belongs to a site is learned from its pages (lines, labels and headings
of link blocks that recur over different articles), and what links is read from the links. The only
phrases are those of notices and placeholders, which problem 7 has to know.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick

# --- line kinds -----------------------------------------------------------------------------
NONE, PROSE, HEAD, ITEM, TABLE, CODE, IMAGE, QUOTE, TITLE = range(9)

# --- what the site's pages say about a line (bits) --------------------------------------------
RECURS, HEADS, LABELLED, SIGNED = 1, 2, 4, 8

# --- evidence of leftovers and notices (bits) -----------------------------------------------
EV_PLACEHOLDER, EV_FILLER, EV_ERROR, EV_SCRIPT = 1, 2, 4, 8


def _alternatives(text: str, flags: int = re.S) -> re.Pattern:
    """One pattern of the alternatives written between free-standing bars or on lines of their own."""
    parts = [x.strip() for x in re.split(r"(?:^|\s)\|\s|\n", text)]
    return re.compile("(?:" + "|".join(x.replace("\\ ", " ") for x in parts if x) + r")\Z", flags)


# Phrases of error, access and parking notices and of script-required notices.
_ERROR = _alternatives(r"""
    (?:error\ )?[45]\d\d(?:\ ?[-–:]?\ (?:nothing\ here|page\ not\ found|not\ found|forbidden|access\ denied|unauthorized|bad\ request|bad\ gateway|gateway\ time-?out|internal\ server\ error|service\ (?:temporarily\ )?unavailable|too\ many\ requests|gone|error).*)?
    | (?:http\ )?error\ [45]\d\d.* | (?:internal\ server\ error|bad\ gateway|gateway\ time-?out|service\ (?:temporarily\ )?unavailable|page\ not\ found|not\ found|access\ denied|forbidden|permission\ denied|too\ many\ requests|oops!?|something\ went\ wrong\.?|not\ available|temporarily\ unavailable|are\ you\ a\ robot\?|site\ under\ construction|under\ construction|coming\ soon!?)
    | .*\bcould\ not\ be\ found\ on\ this\ server.* | .*\bpage\ you\ (?:are\ looking\ for|requested)\b.* | .*can(?:'|’|no)t\ seem\ to\ find\b.* | .*unexpected\ condition\ was\ met.* | .*planned\ maintenance.*be\ back.* | .*(?:server\ returned\ an\ invalid\ response|server\ encountered).*
    | upstream\ request\ timeout.* | request\ id\ .{3,60} | reference:\ ?[a-z0-9-]{4,20} | incident\ (?:id\ |no\.?\ )?[\da-f-]{4,}.* | (?:error\ )?(?:code|ray\ id):?\ ?[a-z0-9-]{4,30}
    | .*(?:don['’]t|do\ not)\ have\ permission\ to\ .* | .*unusual\ traffic\ from\ your\ network.* | verify\ (?:that\ )?you\ are\ (?:a\ )?human.* | .*request\ looks\ automated.* | .*complete\ the\ (?:check|captcha)\ to\ continue.* | .*(?:isn['’]t|is\ not)\ available\ in\ your\ (?:region|country).*
    | .{3,80}\ is\ parked\.? | .*domain\ is\ (?:parked|for\ sale).* | .*contact\ your\ hosting\ provider.* | .*has\ not\ uploaded\ a\ web\ ?page.* | .*a\ new\ site\ will\ be\ published.* | .*check\ back\ (?:later|soon)\.?
    | warning:\ .{0,60}(?:database|mysql|include|undefined).* | .*cannot\ connect\ to\ (?:the\ )?database.* | fatal\ error:.* | (?:uncaught\ )?exception\ in\ thread\ .* | traceback\ \(most\ recent\ call\ last\):? | at\ [\w.$]+\((?:[\w./-]+:\d+|line\ \d+|native\ method)\) | (?:go\ back|return\ to\ (?:the\ )?(?:start|home)\ ?page|back\ to\ (?:the\ )?(?:start|home)\ ?page|try\ again)\.?
    | .*page\ (?:introuvable|non\ trouvée).* | .*seite\ (?:wurde\ )?nicht\ gefunden.* | .*página\ no\ (?:encontrada|existe).* | .*(?:页面不存在|找不到(?:该)?页面|页面未找到|访问被拒绝|服务器错误|无权访问).* | la\ page\ demandée\ .{0,60} | die\ angeforderte\ seite\ .{0,60} | la\ página\ solicitada\ .{0,60} | 您(?:访问|请求)的页面.{0,30}
    | (?:erreur|fehler|error|错误)\ [45]\d\d.* | .*(?:accès\ refusé|zugriff\ verweigert|acceso\ denegado).* | .*(?:en\ construction|im\ aufbau|en\ construcción|网站建设中|敬请期待).{0,20}
    """, re.I | re.S)
_SCRIPT = _alternatives(r"""
    .*(?:enable|turn\ on|switch\ on|activate|allow)\ (?:java\ ?script|scripts?|scripting)\b.* | .*java\ ?script\ is\ (?:disabled|required|off|turned\ off).* | java\ ?script\ required\.? | .*requires?\ (?:a\ browser\ with\ )?(?:java\ ?script|scripting).* | noscript | loading\ ?(?:…|\.\.\.)? | .*checking\ your\ browser.* | .*please\ wait\ while\ we\ (?:check|verify).*
    | .*activez?\ java\ ?script.* | .*activer\ java\ ?script.* | .*aktivieren\ sie\ java\ ?script.* | .*java\ ?script\ (?:aktivieren|activer|activar|nécessaire|erforderlich|necesario).* | .*(?:active|habilite|activar|habilitar)\ java\ ?script.* | .*(?:启用|开启|打开).{0,6}(?:java\ ?script|脚本).* | (?:chargement|wird\ geladen|cargando|加载中|正在加载)\ ?(?:…|\.\.\.|……)?""", re.I | re.S)
_TEMPLATE = re.compile(r"\{\{.{1,40}?\}\}|\{%.{1,40}?%\}|<%=?.{1,40}?%>|\[%.{1,40}?%\]|#\{.{1,40}?\}|\$\{.{1,40}?\}|%%[\w.]{2,40}%%|%[A-Z][A-Z0-9_]{2,40}%|\[\[.{1,40}?\]\]|__\w[\w.]{2,40}?__|<<.{1,40}?>>")
_PLACEHOLDER = _alternatives(r"""
    (?:page\ |article\ |post\ )?(?:title|headline|heading|subtitle|text|content|body|caption|lead|summary|name|author|date)(?:\ text)?\ (?:goes\ here|tbd|to\ come|here)\.? | to\ ?do\b:?.{0,60} | .{0,40}\b(?:tbd|tbc|tba)\b.{0,10} | (?:tk\ ?)+ | (?:x{3,}\ ?)+ | (?:untitled(?:\ (?:draft|page|document|post))?|new\ (?:page|post|article|document)|sample\ page|hello\ world!?)
    | \[(?:insert|add|placeholder|your|caption|image|photo|text|title|name|to\ come|tk|todo)\b.{0,60}\] | \[[^\]]{0,40}\bto\ come\] | (?:your|add\ your|insert|enter\ your|type\ your|put\ your|replace\ this)\ .{0,30}\b(?:here|text|content|copy|paragraph|block)\b.{0,80} | (?:null|undefined|nan|none|nil|n/a|\[object\ object\])
    | (?:null|undefined|nan|none|nil|\[object\ object\])\ (?:by|on|von|par|por)\ .{1,60} | .{0,40}\b(?:invalid\ date|0000-00-00)\b.{0,20}""", re.I | re.S)
# Every phrase above that can stand in a line of more than SHORT characters holds one of
# these, so that such a line with none needs no pattern. Shorter lines, which repeat, are remembered.
SHORT = 48
_STEMS = tuple(
    """error|erreur |fehler |错误|not found|nothing here|forbidden|denied|unavailable|gateway|time-out|timeout|too many requests|unauthorized|bad request|available in your|be found on this|page you
    |seem to find|unexpected condition|planned maintenance|server returned|server encountered|request id|incident |permission to|unusual traffic|you are human|you are a human|looks automated|to continue
    |parked|domain is|hosting provider|not uploaded|new site will|check back|warning: |to database|to the database|exception in|traceback|introuvable|non trouvée|nicht gefunden|página no
    |不存在|找不到|未找到|被拒绝|服务器|无权|page demandée|angeforderte|solicitada|您访问|您请求|refusé|verweigert|denegado|en construcción|en construction|im aufbau|建设中|敬请期待
    |javascript|java script|script|checking your|please wait|脚本|text here|content here|copy here|paragraph here|block here|tbd|tbc|tba|to come|todo:|to do:|xxx
    |[insert|[add|[placeholder|[your|[caption|[image|[photo|[text|[title|[name|your text|your content|your copy|your paragraph|insert |replace this|type your|enter your|put your|add your|null by|null on|undefined|object object|none by|none on|nil by|invalid date|0000-00-00
    |{{|{%|<%|[%|#{|${|%%|[[|__|<<|lorem|ipsum|dolor|textus|textum|placeholder|filler|copia|quis |aute |sint |velit|magna|nostra|nulla|culpa""".replace("\n    ", "").split("|")
)

_SHORT_STEMS = ("here", "tk", "todo", "to do", "untitled", "new ", "sample", "hello", "null", "nan", "none", "nil", "n/a", "found", "available", "oops", "code", "ray id", "reference", "go back", "return", "back to", "try again", "loading", "chargement", "geladen", "cargando", "加载", "robot", "soon", "construction", "aufbau", "your", "error", "erreur", "fehler")

# Words of filler text.
FILLER_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim
    ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit
    esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
    vel risus quod vitae nostra textus textum copia sample demo filler placeholder""".split()
)

_LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)(?:\s[^)]*)?\)")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_LETTER = re.compile(r"[^\W\d_]")
_DIGITS = re.compile(r"\d+")
_SPACES = re.compile(r"\s+")
_MARKS = re.compile(r"^(?:[#>\s]+|[-*+•]\s+|\d{1,3}[.)]\s+)+")
_SENTENCE = re.compile(r"[.!?…。！？]['\"”’)\]*_]*\s*\Z")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_WORDS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[一-鿿]")
_LABEL = re.compile(r"^\W*([^\W\d_][^:：>»›|]{0,30}?)\s*([:：>»›])")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", re.I)


def norm_line(line: str) -> str:
    """Letter case, white space and the value of digit runs do not count."""
    return norm_lower(line.lower())


_ZEROS = bytes.maketrans(b"123456789", b"000000000")


def norm_lower(low: str) -> str:
    if low.isascii():
        raw = low.encode().translate(_ZEROS)
        while b"00" in raw:
            raw = raw.replace(b"00", b"0")
        return " ".join(raw.decode().split())
    return " ".join(_DIGITS.sub("0", low).split())


def has_letter(line: str) -> bool:
    return _LETTER.search(line) is not None


def _core(line: str) -> str:
    s = _MARKS.sub("", line)
    s = _LINK.sub(r"\1", s) if "](" in s else s
    return _SPACES.sub(" ", s.strip().strip("*_ ").strip())


def _sentence_evidence(low: str) -> int:
    ev = 0
    if _PLACEHOLDER.match(low):
        ev |= EV_PLACEHOLDER
    if _ERROR.match(low):
        ev |= EV_ERROR
    if _SCRIPT.match(low):
        ev |= EV_SCRIPT
    return ev


def _automaton(stems):
    found = ahocorasick.Automaton()
    for stem in stems:
        found.add_word(stem, True)
    found.make_automaton()
    return found


_HINTS, _SHORT_HINTS = _automaton(_STEMS), _automaton((*_STEMS, *_SHORT_STEMS))


def line_evidence(line: str, low: str) -> tuple[int, int]:
    """Evidence bits of a line (``low``: in lower case), whatever its length, and the characters of its
    sentences that are evidence: a line that is no notice as a whole is read sentence by sentence."""
    if next((_SHORT_HINTS if len(line) <= SHORT else _HINTS).iter(low), None) is None:
        start = low.lstrip(" \t#>*-_(")
        if not (start.startswith("at ") or start[:1] in "45"):
            return 0, 0
    return _short_evidence(line) if len(line) <= SHORT else _evidence(line)


@lru_cache(maxsize=16384)
def _short_evidence(line: str) -> tuple[int, int]:
    return _evidence(line)


def _evidence(line: str) -> tuple[int, int]:
    core = _core(line)
    if not has_letter(core):
        return (EV_ERROR, len(line)) if re.fullmatch(r"[45]\d\d", core) and line.lstrip().startswith("#") else (0, 0)
    holes = len(_TEMPLATE.findall(line))
    if holes and len(_WORDS.findall(_TEMPLATE.sub(" ", core))) <= 3 * holes + 1:
        return EV_PLACEHOLDER, len(line)
    low = core.lower()
    words = _WORDS.findall(low)
    if len(words) >= 2 and sum(w in FILLER_WORDS for w in words) * 2 > len(words) and (len(words) >= 5 or not {"lorem", "ipsum", "textus", "textum", "placeholder", "filler", "copia"}.isdisjoint(words)):
        return EV_FILLER, len(line)
    parts = _SENTENCES.split(core)
    if len(parts) == 1:
        ev = _sentence_evidence(low)
        return ev, len(line) if ev else 0
    if len(parts) == 2 or len(core) <= 2 * SHORT:  # a notice may run over the end of a sentence
        ev = _sentence_evidence(low)
        if ev and len(core) <= 170:
            return ev, len(line)
    ev = held = 0
    for part in parts:
        own = _sentence_evidence(part.lower())
        ev |= own
        held += len(part) if own else 0
    return ev, held


def site_words(url: str | None, site: str | None) -> tuple[str, ...]:
    """Names by which a site may call itself: parts of its host of at least five letters."""
    host = site or re.sub(r"^[a-z]+://", "", (url or "").lower()).split("/")[0].split("?")[0]
    return tuple(p for p in re.split(r"[^a-z]+", host) if len(p) >= 5)


@lru_cache(maxsize=256)
def _own_names(names: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(sorted({n[:k] for n in names for k in range(5, len(n) + 1)}, key=len, reverse=True)) + r")\b")


def without_names(norm: str, names: tuple[str, ...]) -> str:
    """The line with each word by which the site names itself masked, so that a line all sites use is one line."""
    for n in names:
        if n[:5] in norm:
            return _own_names(names).sub("§", norm)
    return norm


_LAST = re.compile(r"[.!?。！？]\s*([^\W\d_]{5,}[^.!?。！？]{0,35})[.。]\Z")


def is_signed(line: str, names: tuple[str, ...]) -> bool:
    """The line ends in a sentence that is nothing but the site's own name, of up to three words."""
    if not names:
        return False
    m = _LAST.search(line[-60:].rstrip())
    if m is None or m[1].count(" ") > 2:
        return False
    first = m[1].split(" ")[0].lower()
    return any(n.startswith(first) for n in names)


def is_sentence(line: str) -> bool:
    """The line ends as a sentence does, whatever quotes, brackets or marks close it."""
    return _SENTENCE.search(line, max(0, len(line) - 16)) is not None


def label_of(line: str, kind: int) -> str:
    """The label that opens a line which is no sentence, such as the first place of a path or the
    word before a colon; or else what is left of a short line of names and numbers, such as who wrote
    a text and when. '' where there is neither."""
    if kind not in (PROSE, ITEM) or is_sentence(line):
        return ""
    m = _LABEL.match(line)
    if m is not None:
        return norm_line(m[1] + m[2])
    if kind == PROSE and len(line) <= 160:
        masked = masked_line(line)
        left = sum(map(str.isalpha, masked))
        if "¤" in masked and left <= 20 and (left or "0" in masked):
            return masked
    return ""


def links_of(line: str, host: str) -> tuple[int, int, int, int]:
    """Visible characters of a line, those in links to the page's own site, those in links elsewhere,
    and the number of links. Pictures are no links."""
    own = other = links = 0
    for m in _LINK.finditer(line):
        if m[0][0] == "!":
            continue
        to = _HOST.match(m[2])
        links += 1
        if to is None or to[1].lower() == host:
            own += len(m[1].strip())
        else:
            other += len(m[1].strip())
    return len(_MARKS.sub("", _LINK.sub(r"\1", line)).strip()), own, other, links


def kinds_of(lines: list[str]) -> list[int]:
    """The Markdown kind of each line."""
    kinds, fence = [NONE] * len(lines), False
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            continue
        if s.startswith(("```", "~~~")):
            fence = not fence
            kinds[i] = CODE
        elif fence:
            kinds[i] = CODE
        elif s[0] == "#":
            kinds[i] = TITLE if s.startswith("# ") else HEAD
        elif s[0] == "|":
            kinds[i] = TABLE
        elif s[0] == ">":
            kinds[i] = QUOTE
        elif s[0] == "!" and _IMAGE.fullmatch(s):
            kinds[i] = IMAGE
        else:
            kinds[i] = ITEM if _MARKS.match(s) else PROSE
    return kinds


def density(chars: float, linked: float, tags: int, link_tags: int, ratio: float) -> float:
    """Composite text density of a node: characters per tag, adjusted by the share of its characters
    and tags that are links; ``ratio`` is that share over the body. A node of links alone has 0."""
    if chars <= 0 or linked >= chars:
        return 0.0
    tags, linked, link_tags = max(tags, 1), max(linked, 1.0), max(link_tags, 1)
    base = math.log(chars / (chars - linked) * linked + ratio * chars + math.e)
    return chars / tags * max(math.log(max(chars / linked * tags / link_tags, 1.0)), 0.0) / max(base, 1.0)


def outside_lines(run: list[int], kind: list[int], size: list[int], own: list[int], other: list[int], tags: list[int], bits: list[int]) -> list[bool]:
    """For each line whether it lies outside the main body, by composite text density.

    The tree is body, sections (from one title to the next), runs of lines between blank lines,
    lines. Link characters are those of links to the own site, half of those of other links, and all
    characters of a line that recurs over the site's articles, opens with a label that does, or stands
    in a run under a heading of such blocks. The section whose runs have the largest sum of densities
    is the main body; a run elsewhere belongs to it from the least density on the path from that
    section to the body on. Of the runs that belong, lines without any density are cut off.
    """
    n = len(run)
    linked, headed, under, last = [0.0] * n, False, False, -1
    for k in range(n):
        if run[k] != last:
            under, last = False, run[k]
        all_of_it = bits[k] != 0
        if under and not all_of_it and kind[k] not in (TITLE, CODE, TABLE):
            all_of_it = True
        linked[k] = size[k] if all_of_it else min(size[k], own[k] + other[k] / 2)
        under = bits[k] & HEADS > 0 or under and kind[k] != TITLE
    runs: list[list[int]] = []
    for k in range(n):
        if runs and run[runs[-1][0]] == run[k]:
            runs[-1].append(k)
        else:
            runs.append([k])
    total, all_linked = sum(size), sum(linked)
    ratio = all_linked / max(total, 1)

    def sums(ks) -> tuple[float, float, int, int]:
        return sum(size[k] for k in ks), sum(linked[k] for k in ks), sum(tags[k] for k in ks), sum(tags[k] if linked[k] >= size[k] else tags[k] - 1 for k in ks)

    parts = [sums(r) for r in runs]
    dens = [density(*p, ratio) for p in parts]
    starts = [r for r, ks in enumerate(runs) if any(kind[k] == TITLE and not bits[k] for k in ks)]
    spans = [(a, b) for a, b in zip(starts, [*starts[1:], len(runs)])] or [(0, len(runs))]
    best = max(spans, key=lambda ab: (sum(dens[ab[0] : ab[1]]), -ab[0]), default=(0, 0))
    whole = [sum(p[x] for p in parts) for x in range(4)]
    inner = [sum(p[x] for p in parts[best[0] : best[1]]) for x in range(4)]
    threshold = min(density(*whole, ratio), density(*inner, ratio))
    out = [False] * n
    for r, ks in enumerate(runs):
        inside = best[0] <= r < best[1] or dens[r] >= threshold
        for k in ks:
            out[k] = not inside or size[k] > 0 and linked[k] >= size[k]
    return out


def prose_weight(line: str) -> int:
    """Characters of a line; those of scripts without spaces count three times."""
    return len(line) + 2 * len(_CJK.findall(line)) if not line.isascii() else len(line)


# Names: rows of words that begin with a capital.
_NAME = re.compile(r"[A-ZÀ-ÞΆ-ΫЀ-Я]\w*(?:[ '’.-]{1,2}[A-ZÀ-ÞΆ-ΫЀ-Я]\w*)+")
# Beginnings of the names of months.
_MONTH = "(?:jan|feb|fév|mar|mär|apr|avr|abr|may|mai|jun|jui|jul|aug|aoû|ago|sep|oct|okt|nov|dec|dez|déc|dic|ene)[^\\W\\d_]{0,8}[., ]+"
_DATE = re.compile(rf"0(?:[-/.:, 年月日]+(?:{_MONTH})?0)+[年月日]?")
_MONTH_DAY = re.compile(rf"\b{_MONTH}0(?![^\W_])")


def masked_line(line: str, norm: str | None = None) -> str:
    """The line with numbers, dates and names masked, in lower case and with white space runs as one
    space. Names are rows of capitalised words; a line of little else keeps its words."""
    norm = norm_line(line) if norm is None else norm
    named = _NAME.sub("¤", line)
    s = norm if named == line else norm_line(named)
    if "0" in s:
        s = _DATE.sub("0", s)
        if " 0" in s:
            s = _MONTH_DAY.sub("0", s)
    return norm if "¤" in s and len(s) < 40 and "0" not in s and sum(map(str.isalpha, s)) < 4 else s
