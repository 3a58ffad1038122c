"""One pass over a document: its lines, their headers and sections (G1-G3), and the concepts of the rules.

The rules look at one line and at three values that are carried along the lines, so a document is read once, in order, and
no line leaves its document: nothing is exploded, numbered by windows or shuffled.  What a line gives within a context is
kept, so lines that come again cost a look-up; what is kept is bounded between Arrow batches, whatever the lines are.
"""
from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa

from ..functions.arrow import lists as _lists
from ..functions.arrow import struct as _struct
from ..functions.config import ASSERTABLE, DIAGNOSIS, DRUG, DRUG_INDICATIONS, DRUG_LEAD_INS, FAMILY, FILLERS, HISTORICAL, LAB_NAME, LAB_RESULT, NEGATED, OTHER, SECTION_TYPE, SYMPTOM
from ..functions.fuzzy import ratio
from ..functions.settings import Settings
from ..functions.text import NUMBER, SPAN_LEFT, SPAN_RIGHT, TOKEN_LEFT, TOKEN_RIGHT, TRIM, normal_form

CONCEPTS = "array<struct<ord:struct<line_no:int,part_no:int,sub:int>,text:string,type:string,start:int,end:int,assertions:array<string>,candidates:array<string>>>"
LINES = "array<struct<line_no:int,line_start:int,line:string,kind:string,header:string,canonical:string,section:string,section_header:string,doc_section:string>>"
SPANS = "array<struct<canonical:string,char_start:int,char_end:int,header_text:string,doc_section:string>>"

#: Cleaned concepts by their number in the given array; windows with the numbers of the concepts inside.
TIDIED = "array<struct<i:int,text:string,start:int,end:int>>"
WINDOWS = "array<struct<window:int,w0:int,w1:int,members:array<int>>>"

#: Runs of tokens from token ``i``, characters s to e, and their dictionary key.
RUNS = "array<struct<i:int,s:int,e:int,norm:string>>"

#: Lines and characters that are kept between batches.
_LINES, _CHARS = 100_000, 16_000_000

# Python's white space is Java's with the four separators, so these are the patterns of the inventory as they stand
_NUMBERED = re.compile(r"^\s*\d+\s*[.)]\s*(.+?)\s*$")
_BULLET = re.compile(r"^\s*[-*•]\s*")
_LABEL = re.compile(r"^\s*([^:\n]{3,60}?)\s*:\s*(.*)$")
_LABELLED = re.compile(r"^\s*[^:\n]{3,60}?\s*:\s*")
_TO_COLON = re.compile(r"^[^:]*:\s*")
_LEAD_IN = re.compile(rf"(?i)^\s*(?:{'|'.join(DRUG_LEAD_INS)})\s+")
_INDICATION = re.compile(rf"(?i)\s+(?:{'|'.join(DRUG_INDICATIONS)})\b.*$")
_BRACKET = re.compile(r"\s*\([^)]*\)?\s*$")
_NUMBER = re.compile(NUMBER, re.ASCII)
_GROUPS = re.compile("(?<=[^\n\r\x85\u2028\u2029])(?:\\s*[(（\\[][^)）\\]]*[)）\\]]\\s*)+\\Z")
_MARKS = re.compile(r"[\W\d_]+")
_FILLERS = frozenset(normal_form(f) for f in FILLERS)


def _cues(cues: list[str]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(re.escape(c.lower()) for c in cues) + r")\b" if cues else r"(?!)")


def _trimmed(text: str, start: int) -> tuple[str, int]:
    rest = text.lstrip(TRIM)
    return rest.rstrip(TRIM), start + len(text) - len(rest)


class _Context:
    """What is carried along the lines, and for each line met in it: its size, the context from it on, its concepts."""

    def __init__(self, section: str, header: str, doc_section: str, number: int):
        self.section, self.header, self.doc_section, self.number = section, header, doc_section, number
        self.steps: dict[str, tuple[int, _Context, int, int]] = {}


class Reader:
    def __init__(self, settings: Settings, fuzzy: bool = True):
        self.settings, self.fuzzy = settings, fuzzy
        self.patterns = [(i, c, p) for i, (c, p) in enumerate((c, p) for c, ps in settings.sections.items() for p in ps)]
        self.first = {p: c for _, c, p in reversed(self.patterns)}  # equal patterns: the first in order
        self.sorted = [(c, " ".join(sorted(p.split()))) for _, c, p in self.patterns]
        self.letters = {ch: i for i, ch in enumerate(sorted({ch for _, p in self.sorted for ch in p}))}
        self.bags = np.array([self._bag(p) for _, p in self.sorted]).reshape(len(self.sorted), len(self.letters))
        self.sizes = np.array([len(p) for _, p in self.sorted])
        longest = max((len(p) for _, _, p in self.patterns), default=0)
        self.near = longest * (200 - settings.fuzz_threshold) / settings.fuzz_threshold if fuzzy else -1  # longer headers cannot reach the threshold
        # a bare header must be equal to a pattern, be covered by one, or be similar enough: none of these can be much longer
        self.bare = longest / min(settings.substr_coverage, settings.bare_conf / (2 - settings.bare_conf))
        cues = settings.cues
        self.negated, self.historical, self.family = (_cues(cues[n]) for n in ("isNegated", "isHistorical", "isFamily"))
        self.exceptions = [x.lower() for x in cues["negation_exceptions"]]
        self.past_headers = [x.lower() for x in cues["historical_section_headers"]]
        longest_first = sorted((x.lower() for x in cues["isNegated"]), key=lambda x: (-len(x), x))
        self.leading = re.compile(rf"^(?:{'|'.join(map(re.escape, longest_first))})(?= |\Z)\s*") if longest_first else re.compile(r"(?!)")
        self.ascii = re.compile(f"[A-Za-z]{{{settings.drug_min_ascii},}}")
        self.clear()

    def clear(self) -> None:
        self.contexts: dict[tuple, _Context] = {}
        self.begin = self._context(OTHER, "", OTHER)
        self.heads: dict[str, tuple] = {}
        self.pieces: list[str] = []  # by number, as kept steps name them
        self.numbers: dict[str, int] = {}
        self.found: list[list[tuple]] = [[]]  # concepts of a line by number; 0 is none
        self.marks: dict[tuple, list[str]] = {}
        self.chars = 0

    def ready(self) -> None:
        """To be called before a batch: forgets what is kept when it has grown too much."""
        if self.chars > _CHARS or len(self.pieces) > _LINES or len(self.found) > _LINES or len(self.marks) > _LINES:
            self.clear()

    def _context(self, *key) -> _Context:
        if key not in self.contexts:
            self.contexts[key] = _Context(*key, len(self.contexts))
        return self.contexts[key]

    def _bag(self, text: str) -> np.ndarray:
        """How often each letter of the patterns occurs."""
        return np.bincount(np.array([self.letters[ch] for ch in text if ch in self.letters], np.int64), minlength=len(self.letters)) if text and self.letters else np.zeros(len(self.letters), np.int64)

    # --- G1, G2

    def canonical(self, header: str | None) -> tuple[str | None, float]:
        """G1: section of a header text and confidence: equal; covered by the longest pattern inside; similar; any pattern inside; ties go to the first pattern."""
        h = normal_form(header or "").strip()
        if not h:
            return None, 0.0
        if (exact := self.first.get(h)) is not None:
            return exact, 1.0
        inside = min(((-len(p), i, c) for i, c, p in self.patterns if p and p in h), default=None)
        if inside and -inside[0] >= self.settings.substr_coverage * len(h):
            return inside[2], 0.99
        if len(h) <= self.near:
            s, best, top = " ".join(sorted(h.split())), None, 0.0
            # no common subsequence is longer than the letters that both have
            most = 200.0 * np.minimum(self.bags, self._bag(s)).sum(1) / np.maximum(self.sizes + len(s), 1)
            for i in np.flatnonzero(most >= self.settings.fuzz_threshold - 1e-9).tolist():
                if (r := ratio(s, self.sorted[i][1])) > top:
                    best, top = self.sorted[i][0], r
            if best is not None and top >= self.settings.fuzz_threshold:
                return best, top / 100.0
        return (inside[2], 0.60) if inside else (None, 0.0)

    def head(self, line: str) -> tuple[str | None, str | None, str | None]:
        """Kind (num, colon, bare or none), header and section of a line."""
        body = _BULLET.sub("", line, count=1)
        if m := _NUMBERED.search(line):
            kind, text = "num", m[1]
        elif m := _LABEL.search(body):
            kind, text = "colon", m[1]
        else:
            kind, text = "bare", body.strip()
        if text == "" or not line.strip() or (kind == "bare" and len(text) > self.bare):
            return None, None, None
        canon, confidence = self.canonical(text)
        if kind == "num" or (canon is not None and (kind == "colon" or confidence >= self.settings.bare_conf)):
            return kind, text, OTHER if canon is None else canon
        return None, None, None

    # --- A1-A5

    def negation(self, text: str) -> int:
        """A5: length of a leading negation cue with the white space after it."""
        low = text.lower()
        if any(low.startswith(x) for x in self.exceptions):
            return 0
        m = self.leading.search(low)
        return len(m[0]) if m else 0

    def assertions(self, kind: str, line: str, start: int, context: _Context, by_prefix: bool = False) -> list[str]:
        """A1-A4 of a concept that begins at ``start`` of ``line``."""
        if kind not in ASSERTABLE:
            return []
        low, head = line.lower(), context.header.lower()
        window = low[max(0, start - self.settings.neg_window) : max(0, start)]
        out = []
        if "HISTORY_PAST" in (context.section, context.doc_section) or any(x in head for x in self.past_headers) or self.historical.search(low):
            out.append(HISTORICAL)
        if by_prefix or (self.negated.search(window) and not any(x in window for x in self.exceptions)):
            out.append(NEGATED)
        if self.family.search(low) or self.family.search(head):
            out.append(FAMILY)
        return out

    # --- E1-E7

    def concepts(self, line: str, kind: str | None, context: _Context) -> list[tuple]:
        """(part_no, sub, text, type, start in the line, assertions) of a line in its context."""
        own, lab = SECTION_TYPE.get(context.section), context.section == "LAB" and kind in (None, "colon")
        if not (lab or own) or not line.strip():
            return []
        bullet = _BULLET.search(line)
        listed = kind is None and bullet is not None
        if lab:
            cut = bullet.end() if bullet else 0
            body = line[cut:]
            if not body.strip():
                return []
            if kind == "colon" and (m := _LABELLED.search(body)):
                cut += m.end()
        else:
            m = _TO_COLON.search(line) if kind == "colon" else bullet if listed else _LABELLED.search(line) if kind is None else None
            if m is None:
                return []
            cut = m.end()
        if cut >= len(line) and not (listed and not lab):
            return []
        content, drug, settings, out = line[cut:], own == DRUG, self.settings, []
        spoken = own in (SYMPTOM, DIAGNOSIS)
        at = cut
        for part_no, part in enumerate(content.split(";") if lab else re.split("[,;]", content) if not listed and not drug else [content]):
            t, s = _trimmed(part, at)
            at += len(part) + 1
            if t == "":
                continue
            n = 0
            if lab:
                if not (m := _NUMBER.search(t)):
                    continue
                name, value = _trimmed(t[: m.start()], s), _trimmed(t[m.start() :], s + m.start())
                if name[0] == "" or len(name[0]) > 60:
                    continue
                made = [(0, *name, LAB_NAME), (1, *value, LAB_RESULT)]
            else:
                if spoken:
                    before = t.partition(":")[0]
                    n = self.negation(before)
                    t, s = _trimmed(before[n:], s + n)
                if drug:
                    if m := _LEAD_IN.search(t):
                        t, s = _trimmed(t[m.end() :], s + m.end())
                    for pattern in (_INDICATION, _BRACKET):
                        if pattern.search(t):
                            t, s = _trimmed(pattern.sub("", t, count=1), s)
                if t == "" or len(t) > settings.max_len or len(t.split()) > (settings.max_words_drug if drug else settings.max_words_symptom):
                    continue
                if drug and not self.ascii.search(t):
                    continue
                made = [(0, t, s, own)]
            out += [(part_no, sub, text, k, begin, self.assertions(k, line, begin, context, n > 0)) for sub, text, begin, k in made if text]
        return out

    # --- a document

    def step(self, context: _Context, piece: str) -> tuple[int, _Context, int, int]:
        """(size, context from this line on, number of its concepts' list, number of the line); ``piece`` is a line with its break."""
        number = self.numbers.get(piece)
        if number is None:
            line = piece.splitlines()[0] if piece else ""
            self.heads[piece] = (line, *self.head(line))
            number = self.numbers[piece] = len(self.pieces)
            self.pieces.append(piece)
        line, kind, header, canonical = self.heads[piece]
        after = context if kind is None else self._context(canonical, header, canonical if kind == "num" else context.doc_section)
        found = self.concepts(line, kind, after)
        at = 0
        if found:
            at = len(self.found)
            self.found.append(found)
        made = context.steps[piece] = (len(piece), after, at, number)
        self.chars += len(piece) + len(after.header) + 64
        return made

    def spans(self, raw: str) -> list[tuple]:
        """(canonical, char_start, char_end, header_text, doc_section); contiguous, covering the document."""
        at, context, opened = 0, self.begin, [(-1, OTHER, "", OTHER if raw else "")]  # what stands before any header comes first
        for piece in raw.splitlines(True):
            size, after, _, _ = context.steps.get(piece) or self.step(context, piece)
            if self.heads[piece][1] is not None:
                opened.append((at, after.section, after.header, after.doc_section))
            at, context = at + size, after
        ends = [s for s, *_ in opened[1:]] + [len(raw)]
        return [(c, max(s, 0), e, h, d) for (s, c, h, d), e in zip(opened, ends) if e > max(s, 0) or not raw]


_READERS: dict[tuple, Reader] = {}


def reader(settings: Settings, fuzzy: bool) -> Reader:
    """One reader a worker process, so what it keeps serves all of its tasks."""
    key = (repr(settings), fuzzy)
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(settings, fuzzy)
    _READERS[key].ready()
    return _READERS[key]


# --- Arrow batches


def concepts_of(texts: pa.Array, settings: Settings, fuzzy: bool, types: list[str] | None, kind: pa.DataType) -> pa.Array:
    """The concepts of each text, in order."""
    r = reader(settings, fuzzy)
    counts, which, base, lines, found = [], [], [], [], r.found
    for raw in texts.to_pylist():
        if raw is None:
            counts.append(None)
            continue
        at, context, n = 0, r.begin, 0
        for line_no, piece in enumerate(raw.splitlines(True)):
            size, context, x, _ = context.steps.get(piece) or r.step(context, piece)
            if x:
                which.append(x)
                base.append(at)
                lines.append(line_no)
                n += 1
            at += size
        counts.append(n)
    # the concepts of each distinct list once, then taken as often as the list occurs
    used, at = np.unique(np.array(which, np.int64), return_inverse=True)
    own = [[c for c in found[u] if types is None or c[3] in types] for u in used.tolist()]
    flat = [c for cs in own for c in cs]
    size = np.array([len(cs) for cs in own], np.int64)
    first = np.cumsum(size) - size
    times = size[at]
    idx = np.repeat(first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    bounds = np.concatenate([[0], np.cumsum(times)])
    docs = np.cumsum([0] + [c or 0 for c in counts])
    of_doc = np.diff(bounds[docs])
    column = lambda i, t: pa.array([c[i] for c in flat], t)
    item = kind.value_type
    ends = [c[4] + len(c[2]) for c in flat]
    offset = np.repeat(np.array(base, np.int64), times)
    begin = np.array([c[4] for c in flat], np.int64)[idx] + offset if len(idx) else np.zeros(0, np.int64)
    end = np.array(ends, np.int64)[idx] + offset if len(idx) else begin
    take = lambda a: a.take(pa.array(idx))
    order = _struct(item.field("ord").type, [pa.array(np.repeat(np.array(lines, np.int32), times)), take(column(0, pa.int32())), take(column(1, pa.int32()))])
    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(idx) + 1, np.int32)), pa.array([], pa.string()), type=item.field("candidates").type)
    values = _struct(item, [order, take(column(2, pa.string())), take(column(3, pa.string())), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), take(column(5, item.field("assertions").type)), none])
    return _lists([None if c is None else int(n) for c, n in zip(counts, of_doc)], values, kind)


def lines_of(texts: pa.Array, settings: Settings, fuzzy: bool, kind: pa.DataType) -> pa.Array:
    """The lines of each text with their headers and sections."""
    r = reader(settings, fuzzy)
    counts, which, base, lines, after = [], [], [], [], []
    for raw in texts.to_pylist():
        if raw is None:
            counts.append(None)
            continue
        at, context, line_no = 0, r.begin, -1
        for line_no, piece in enumerate(raw.splitlines(True)):
            size, context, _, x = context.steps.get(piece) or r.step(context, piece)
            which.append(x)
            base.append(at)
            lines.append(line_no)
            after.append(context.number)
            at += size
        counts.append(line_no + 1)
    used, at = np.unique(np.array(which, np.int64), return_inverse=True)
    own = [r.heads[r.pieces[u]] for u in used.tolist()]
    seen, then = np.unique(np.array(after, np.int64), return_inverse=True)
    every = list(r.contexts.values())
    contexts = [every[i] for i in seen.tolist()]
    line = lambda i: pa.array([o[i] for o in own], pa.string()).take(pa.array(at))
    carried = lambda name: pa.array([getattr(c, name) for c in contexts], pa.string()).take(pa.array(then))
    values = _struct(kind.value_type, [pa.array(lines, pa.int32()), pa.array(base, pa.int32()), *[line(i) for i in range(4)], *[carried(n) for n in ("section", "header", "doc_section")]])
    return _lists(counts, values, kind)


def spans_of(texts: pa.Array, settings: Settings, fuzzy: bool, kind: pa.DataType) -> pa.Array:
    """The sections of each text."""
    r = reader(settings, fuzzy)
    found = [None if raw is None else r.spans(raw) for raw in texts.to_pylist()]
    flat = [s for f in found for s in f or ()]
    values = _struct(kind.value_type, [pa.array([s[i] for s in flat], f.type) for i, f in enumerate(kind.value_type)])
    return _lists([None if f is None else len(f) for f in found], values, kind)


def marks_of(texts: pa.Array, starts: pa.Array, kinds: pa.Array, settings: Settings, fuzzy: bool, kind: pa.DataType) -> pa.Array:
    """The assertions of each text's concepts, given by start and type, from the last line that begins at or before each."""
    r = reader(settings, fuzzy)
    out = []
    for raw, at_, types in zip(texts.to_pylist(), starts.to_pylist(), kinds.to_pylist()):
        if raw is None or not at_:
            out.append(None if at_ is None else [[] for _ in at_])
            continue
        begins, places, at, context = [], [], 0, r.begin
        for piece in raw.splitlines(True):
            size, context, _, x = context.steps.get(piece) or r.step(context, piece)
            begins.append(at)
            places.append((x, context))
            at += size
        own = []
        for start, t in zip(at_, types):
            i = bisect_right(begins, start) - 1
            x, context = places[i] if i >= 0 else (-1, r.begin)
            rel = start - (begins[i] if i >= 0 else 0)
            key = (x, context.number, rel, t)
            if (m := r.marks.get(key)) is None:
                m = r.marks[key] = r.assertions(t, r.heads[r.pieces[x]][0] if x >= 0 else "", rel, context)
            own.append(m)
        out.append(own)
    return pa.array(out, kind)


# --- W7, W10: concepts beside their text


def stripped_span(span: str) -> tuple[str, int]:
    """(what is left of a span, how far it begins later): white space, trailing bracket groups, edge punctuation."""
    body = span.lstrip()
    right = _GROUPS.sub("", body.rstrip()).rstrip(SPAN_RIGHT)
    text = right.lstrip(SPAN_LEFT)
    return text, len(span) - len(body) + len(right) - len(text)


def is_garbage(text: str) -> bool:
    """W8."""
    t = text.strip()
    return len(t) <= 2 or _MARKS.fullmatch(t) is not None or normal_form(t) in _FILLERS


def tidied(texts: pa.Array, starts: pa.Array, ends: pa.Array, kinds: pa.Array, final: bool, kind: pa.DataType) -> pa.Array:
    """The spans without white space and edges; if ``final``, without empty ones, garbage and later ones of equal place and type."""
    known: dict[str, tuple] = {}
    counts, which, left, begins = [], [], [], []
    for raw, at, to, types in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), kinds.to_pylist()):
        seen, n = set(), 0
        for i, (s, e, t) in enumerate(zip(at or (), to or (), types or ())):
            if raw is None or s is None or e is None:
                continue
            span = raw[max(s, 0) : max(e, 0)]
            if (x := known.get(span)) is None:
                if len(known) > _LINES:
                    known.clear()
                text, skip = stripped_span(span)
                x = known[span] = (text, skip, text == "" or is_garbage(text))
            text, skip, bad = x
            if final:
                key = (s + skip, len(text), t)
                if bad or key in seen:
                    continue
                seen.add(key)
            which.append(i)
            left.append(text)
            begins.append(s + skip)
            n += 1
        counts.append(n)
    begin = np.array(begins, np.int64)
    end = begin + np.array([len(t) for t in left], np.int64)
    values = _struct(kind.value_type, [pa.array(which, pa.int32()), pa.array(left, pa.string()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))])
    return _lists(counts, values, kind)


def windows_of(texts: pa.Array, starts: pa.Array, ends: pa.Array, target: int, kind: pa.DataType) -> pa.Array:
    """Windows of whole lines, of at most ``target`` characters where they have more than one, that hold a concept wholly."""
    out = []
    for raw, at, to in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        begins, end = [], 0
        for piece in (raw or "").split("\n"):
            size = min(len(piece) + 1, len(raw or "") - end)  # the feed belongs to the line
            if size and (not begins or end + size - begins[-1] > target):
                begins.append(end)
            end += size
        bounds, members = [*begins, end], {}
        for i, (s, e) in enumerate(zip(at or (), to or ())):
            if s is None or e is None:
                continue
            w = bisect_right(begins, s) - 1
            for v in (w - 1, w) if s == e else (w,):
                if v >= 0 and begins[v] <= s and e <= bounds[v + 1]:
                    members.setdefault(v, []).append(i)
        out.append([{"window": v, "w0": begins[v], "w1": bounds[v + 1], "members": m} for v, m in sorted(members.items())])
    return pa.array(out, kind)


# --- W2: runs of tokens that may be terms


def runs_of(texts: pa.Array, heads: bytes, terms: bytes, max_words: int, kind: pa.DataType) -> pa.Array:
    """The runs of up to ``max_words`` tokens whose first word and whose key are in the bitmaps."""
    def among(text: str, bits: bytes) -> bool:
        at = zlib.crc32(text.encode()) % (8 * len(bits))
        return bits[at >> 3] >> (at & 7) & 1 == 1

    known: dict[str, tuple[str, bool]] = {}
    keys: dict[tuple, str | None] = {}
    counts, first, begins, ends, norms = [], [], [], [], []
    for raw in texts.to_pylist():
        toks, own, n = [], [], 0
        for m in re.finditer(r"\S+", raw or ""):
            t = m[0]
            if (x := known.get(t)) is None:
                if len(known) > _LINES:
                    known.clear()
                norm = normal_form(t)
                # the first word of a run's key is its first token without edges; a token of edges alone leaves it to the next
                bare = norm.lstrip(TOKEN_LEFT)
                x = known[t] = (norm, any(h == "" or among(h, heads) for h in (bare, bare.rstrip(TOKEN_RIGHT))))
            if x[1]:
                own.append(len(toks))
            toks.append((m.start(), m.end(), x[0]))
        for i in own:
            words = tuple(t[2] for t in toks[i : i + max_words])
            for w in range(1, len(words) + 1):
                run = words[:w]
                if run not in keys:
                    if len(keys) > _LINES:
                        keys.clear()
                    key = " ".join(run).lstrip(TOKEN_LEFT).rstrip(TOKEN_RIGHT)
                    keys[run] = key if key and among(key, terms) else None
                if (key := keys[run]) is not None:
                    first.append(i)
                    begins.append(toks[i][0])
                    ends.append(toks[i + w - 1][1])
                    norms.append(key)
                    n += 1
        counts.append(n)
    values = _struct(kind.value_type, [pa.array(first, pa.int32()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(norms, pa.string())])
    return _lists(counts, values, kind)
