"""Problem 5: speech transcripts into clean speaker turns."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.names import edits

# Sounds of hesitation or assent.
FILLERS = frozenset("uh uhh uhm um umm erm er err ah ahh eh hm hmm hmmm mm mmm mhm mh huh oh aha uhhuh mmhmm mmhm hem ehm".split())
_TITLES = frozenset("dr prof professor mr mrs ms miss sir phd md".split())

_TIME = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
_ARROW = re.compile(rf"^\s*({_TIME})\s*-->\s*({_TIME}).*$")
_LEAD = re.compile(rf"^\s*[\[(<]?({_TIME})[\])>]?(?=\s|$)\s*[-–]?\s*")
_LEAD_BRACKET = re.compile(rf"^\s*[\[(<]({_TIME})[\])>]\s*[-–]?\s*")
_TAIL = re.compile(rf"\s*[\[(]({_TIME})[\])]\s*$")
_VOICE = re.compile(r"^\s*<v(?:\.[\w.]+)?\s+([^>]+)>(.*?)(?:</v>)?\s*$", re.S)
_BOLD = re.compile(r"^\s*\*\*([^*]{1,60})\*\*\s*:?\s*(.*)$", re.S)
_COLON = re.compile(r"^\s*(?:>>\s*|[-–—]\s+)?([^:\n]{1,60}?)\s*:(?:\s+|$)(.*)$", re.S)
_NUMBERED = re.compile(r"^(?:(?:speaker|spk|person|participant|voice|sprecher|locuteur)[\s_#-]*|s|spk)0*(\d{1,3})$", re.I)
# Beginnings of words for sounds. In round brackets or between stars words are a noise only
# with one of these; in square brackets, as transcripts have it, all words are.
SOUNDS = (
    "laugh", "chuckl", "giggl", "cough", "sneez", "sniff", "sigh", "gasp", "groan", "yawn", "breath", "inhal", "exhal", "throat", "cry", "cries", "sob", "scream", "shout", "whisper", "murmur", "mumbl",
    "whistl", "hum", "applau", "clap", "cheer", "music", "song", "sing", "door", "phone", "bell", "ring", "knock", "footstep", "beep", "buzz", "bark", "static", "noise", "sound", "background", "crosstalk",
    "overlap", "inaudible", "unintelligible", "indistinct", "unclear", "silence", "pause", "break",
)
_SOUND = rf"(?=[^)*\n]*\b(?:{'|'.join(SOUNDS)}))"
_NOISE = re.compile(rf"\[[^\]\n]{{0,40}}\]|\*{_SOUND}[^*\n]{{1,30}}\*|\({_SOUND}(?:[a-z]+[ -]?){{1,4}}\)|[♪♫]+|<[^>\n]{{1,20}}>", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_FILLER_SPAN = re.compile(r"(?<![\w'-])(?:" + "|".join(sorted(FILLERS | {"mm-hmm", "uh-huh", "mm-hm"}, key=len, reverse=True)) + r")(?![\w'-])(?:\.\.\.|…|,)?\s*", re.I)


def seconds(mark: str) -> float:
    total = 0.0
    for part in mark.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def name_words(label: str) -> list[str]:
    return [w for w in re.findall(r"[^\W\d_]+", _fold(re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", label))) if w not in _TITLES]


def _word_score(said: str, real: str) -> float:
    if said == real:
        return 1.0
    if len(said) == 1:
        return 0.6 if real[0] == said else 0.0
    if min(len(said), len(real)) >= 4:
        d = edits(said, real, 2)
        if d == 1:
            return 0.8
        if d == 2 and min(len(said), len(real)) >= 6:
            return 0.7
    return 0.0


def speaker_of(label: str, roster: list[tuple[int, str]]) -> int | None:
    """The person of the roster that a label names: by number, or by full, first or last name,
    initials, titles and small typing errors aside; nobody when two fit equally or none does."""
    bare = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", label).strip(" *>-–_:")
    m = _NUMBERED.match(bare) or re.match(r"^#?0*(\d{1,2})$", bare)
    if m:
        no = int(m.group(1))
        return no if any(no == k for k, _ in roster) else None
    said = name_words(label)
    if not said or len(said) > 5:
        return None
    best: list[tuple[float, int]] = []
    for no, full in roster:
        real = name_words(full or "")
        left, score, matched = list(real), 0.0, 0
        for w in sorted(said, key=len, reverse=True):
            fits = [(_word_score(w, r), r) for r in left]
            top = max(fits, default=(0.0, ""))
            if top[0] > 0:
                left.remove(top[1])
                score += top[0]
                matched += 1
        if matched == len(said) and any(len(w) > 1 for w in said):
            best.append((score - 0.05 * len(left), no))
    best.sort(reverse=True)
    if not best or (len(best) > 1 and best[0][0] - best[1][0] < 0.05):
        return None
    return best[0][1]


@dataclass
class Cue:
    """A piece of speech as it stands in the file: place, time where known, speaker where labelled."""

    place: int
    time: float | None = None
    speaker: int | None = None
    text: list[str] = field(default_factory=list)


def read_cues(transcript: str, roster: list[tuple[int, str]]) -> list[Cue]:
    """Cues in order of the file. Lines without label and time go on with the cue before."""
    cues: list[Cue] = []
    known: dict[str, int | None] = {}
    lines = transcript.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    cued = sum(1 for x in lines if _ARROW.match(x) or (_LEAD_BRACKET.match(x) and _LEAD_BRACKET.sub("", x).strip())) >= 2
    arrows = any(_ARROW.match(x) for x in lines)

    def named(label: str) -> int | None:
        if label not in known:
            known[label] = speaker_of(label, roster)
        return known[label]

    pending: float | None = None
    comment = False
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            comment = False
            continue
        if comment or (arrows and re.match(r"^(?:WEBVTT|STYLE|REGION|NOTE)\b(?!:)", s)):
            comment = True
            continue
        if arrows and s.isdigit() and k + 1 < len(lines) and _ARROW.match(lines[k + 1]):
            continue
        m = _ARROW.match(line)
        if m:
            cues.append(Cue(len(cues), seconds(m.group(1))))
            continue
        time = None
        m = _LEAD_BRACKET.match(line)
        if m:
            time, line = seconds(m.group(1)), line[m.end() :]
        elif not cued and (m := _TAIL.search(line)):
            time, line = seconds(m.group(1)), line[: m.start()]
        speaker, text = None, line.strip()
        for rx in (_VOICE, _BOLD, _COLON):
            m = rx.match(line)
            if m and (speaker := named(m.group(1))) is not None:
                text = m.group(2).strip()
                break
        if speaker is None and text.startswith(">>"):
            text = text[2:].strip()
        if time is not None and not text and speaker is None:
            continue  # a time mark by itself says nothing about who speaks
        fresh = arrows and cues and cues[-1].speaker is None and not cues[-1].text
        if fresh:
            cues[-1].speaker = speaker
            cues[-1].text.append(text)
        elif speaker is not None or (time is not None and cued):
            cues.append(Cue(len(cues), time, speaker, [text] if text else []))
        elif cues:
            cues[-1].text.append(text)
    return cues


def ordered(cues: list[Cue]) -> list[Cue]:
    """Cues in an order that keeps every precedence constraint that can be kept.

    Timing: a cue comes before those of later times. File order: a cue comes before the one after it
    in the file. Where they conflict the file's edge gives way; a cue without a time keeps the edge
    to the cue it follows. Repeated cues (same time and text) count once. The order is a topological
    one, the place in the file breaking ties.
    """
    seen: set[tuple[float, str]] = set()
    nodes: list[Cue] = []
    for c in cues:
        key = (c.time, " ".join(c.text))
        if c.time is not None and key in seen:
            continue
        seen.add(key)
        nodes.append(c)
    n = len(nodes)
    after: list[set[int]] = [set() for _ in range(n)]
    timed = sorted((i for i in range(n) if nodes[i].time is not None), key=lambda i: (nodes[i].time, i))
    for a, b in zip(timed, timed[1:]):
        after[a].add(b)
    rank = {i: r for r, i in enumerate(timed)}
    last = None
    for i in range(n):
        if i and nodes[i].time is None:
            after[i - 1].add(i)  # dialogue: it goes on from the cue before
        if i in rank:
            if last is not None and rank[last] < rank[i] and i - 1 >= 0:
                after[i - 1].add(i)
            last = i
    # What follows an untimed cue's leader in time must wait for the untimed cue too.
    lead = None
    for i in range(n):
        if i in rank:
            lead = i
        elif lead is not None and rank[lead] + 1 < len(timed):
            after[i].add(timed[rank[lead] + 1])
    before = [0] * n
    for a in range(n):
        for b in after[a]:
            before[b] += 1
    ready = [i for i in range(n) if not before[i]]
    heapq.heapify(ready)
    out, done = [], [False] * n
    while len(out) < n:
        if not ready:  # constraints that contradict each other: the earliest cue in the file goes first
            i = next(k for k in range(n) if not done[k])
        else:
            i = heapq.heappop(ready)
        if done[i]:
            continue
        done[i] = True
        out.append(nodes[i])
        for b in after[i]:
            before[b] -= 1
            if before[b] == 0 and not done[b]:
                heapq.heappush(ready, b)
    return out


def clean_span(text: str) -> str:
    """Text without noises, time marks and fillers; '' when nothing else is in it."""
    bare = _NOISE.sub(" ", text)
    bare = re.sub(rf"[\[(]{_TIME}[\])]", " ", bare)
    words = [w.lower().replace("-", "").replace("’", "").replace("'", "") for w in _WORD.findall(bare)]
    if all(w in FILLERS for w in words):
        return ""
    bare = _FILLER_SPAN.sub("", bare)
    return re.sub(r"\s+([,.!?;:])", r"\1", re.sub(r"\s+", " ", bare)).strip()


def turns(transcript: str | None, roster: list[tuple[int, str]]) -> list[tuple[int, float | None, str]]:
    """``(speaker_no, start, text)`` of each turn in order of time. Text before any label is dropped."""
    if not transcript or not roster:
        return []
    out: list[list] = []
    speaker = None
    for cue in ordered(read_cues(transcript, roster)):
        said = " ".join(filter(None, (clean_span(t) for t in cue.text)))
        who = cue.speaker if cue.speaker is not None else speaker
        if not said:
            continue
        speaker = who
        if who is None:
            continue
        if out and out[-1][0] == who:
            out[-1][2] += " " + said
        else:
            out.append([who, cue.time, said])
    return [tuple(x) for x in out]


_TURNS = "result_id bigint, turn_no bigint, speaker_no bigint, start_sec double, text string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for rid, text, people in zip(*(batch.column(c).to_pylist() for c in ("result_id", "transcript", "people"))):
            roster = sorted((p["speaker_no"], p["full_name"] or "") for p in people or [] if p["speaker_no"] is not None)
            for k, (who, start, said) in enumerate(turns(text, roster), 1):
                for col, v in zip(cols, (rid, k, who, start, said)):
                    col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["result_id", "turn_no", "speaker_no", "start_sec", "text"])


def speaker_turns(results: DataFrame, speakers: DataFrame) -> DataFrame:
    """Clean turns of each transcript, numbered from 1 in order of time.

    Null and blank transcripts, and those without a roster, give no row; of repeated rows of an
    id the first transcript in order is read; a roster row without number is ignored.
    """
    people = speakers.where("speaker_no is not null").groupBy("result_id").agg(F.collect_set(F.struct("speaker_no", "full_name")).alias("people"))
    rows = results.where("result_id is not null and trim(transcript) <> ''").groupBy("result_id").agg(F.min("transcript").alias("transcript"))
    return rows.join(people, "result_id").select("result_id", "transcript", "people").mapInArrow(_run, _TURNS)
