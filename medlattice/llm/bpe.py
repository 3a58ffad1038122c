"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Merging a prefix of a word settles its tokens once enough of what follows is known.  ``lookahead`` computes how much
that is from the merge list alone, in one pass in rank order: whether a token survives up to rule *i* can only hang on
an earlier rule that takes it as its left part, whose right part in turn must have survived until then, and so on; the
longest such chain, in symbols, bounds what can still change.  ``WordStream`` takes a word in strides, keeps that many
symbols and at most one stride more, and emits every token that ends before them; ``TextStream`` does the same for
normalisation and pre-tokens, so memory does not grow with a text or with a run that has no white space.  Every word of
every text goes through these two; only the ids of words that have ended are remembered.  Decoding feeds the tokens' bytes
through an incremental byte-to-text machine.

The tokenizer file is read once on the driver and shipped with the code (about 1 MB); executors need no such file.
Defined results: null text encodes as the empty text, no ids; special strings inside a text give their special ids, as
the library does; texts and words of any length are streamed.  Rows are independent: repeated rows and null keys give equal
rows; an empty table gives no rows; columns that are not kept are not read, and where a kept one has the name of a result,
the result's name gets underscores (``free_name``).
"""
from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, map_rows

#: Symbols that a word is fed by, ids that are decoded together, characters that a text is fed by.
_STRIDE, _BLOCK, _PIECE = 64, 2048, 1 << 14
_CACHE = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return [chr(b) if b in plain else chr(256 + sum(1 for x in range(b) if x not in plain)) for b in range(256)]


def lookahead(merges: Iterable[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Symbols beyond a token's end that can decide on it, for merges (left, right, result) in rank order.

    ``length`` has the base symbols' lengths (1 each) and is completed with those of the results.  The list must be
    proper: each part is a base symbol or the result of an earlier merge; else ValueError.
    """
    formed: dict[int, int] = dict.fromkeys(length, 0)
    taken: dict[int, int] = {}
    for left, right, made in merges:
        if left not in formed or right not in formed:
            raise ValueError("a merge uses a token that no earlier merge makes")
        depends = max(formed[right], taken.get(right, 0))
        taken[left] = max(taken.get(left, 0), length[right] + depends)
        formed[made] = max(formed.get(made, 0), depends)
        length[made] = length[left] + length[right]
    return max((max(f, taken.get(t, 0)) for t, f in formed.items()), default=0)


class Tokenizer:
    """The merges and tables of a ``tokenizer.json`` with byte-level BPE, lower-casing and word ends."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        known = {"NFC", "Replace", "Lowercase"}
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or {s["type"] for s in steps} - known or spec.get("decoder") is not None and spec["decoder"].get("type") != "ByteLevel":
            raise ValueError("this tokenizer's kind isn't supported")
        self.key = hashlib.sha1(definition.encode()).hexdigest()
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {a << 32 | b: i for i, (a, b, _) in enumerate(rules)}
        self.made = [made for _, _, made in rules]
        self.length = dict.fromkeys([*self.inner, *self.last], 1)
        self.ahead = lookahead(rules, self.length)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if not t.get("normalized")}
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.longest_special = max(map(len, self.special), default=1)
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.byte_level = spec.get("decoder") is not None
        piece: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        back = {c: b for b, c in enumerate(alphabet)} if self.byte_level else {}
        self.raw = {i: bytes(back[c] for c in t) if back and all(c in back for c in t) else t.encode() for i, t in piece.items()}
        self.cache: dict[str, bytes] = {}

    # --- encoding

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a word's symbols: lowest rank first, leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, made = self.rank.get, self.made
        order = [rank(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while order and (best := min(order)) != _NONE:
            i = order.index(best)
            ids[i] = made[best]
            del ids[i + 1], order[i]
            if i < len(order):
                order[i] = rank(ids[i] << 32 | ids[i + 1], _NONE)
            if i:
                order[i - 1] = rank(ids[i - 1] << 32 | ids[i], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        ids, after, before, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[k], i) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or rank.get(ids[i] << 32 | ids[j]) != best:
                continue
            ids[i], alive[j], after[i] = self.made[best], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (k := ids[left] << 32 | ids[right]) in rank:
                    heapq.heappush(heap, (rank[k], left))
        return [t for t, a in zip(ids, alive) if a]

    def word(self, word: str) -> bytes:
        """Packed ids of a whole word, through the stream."""
        stream, out = WordStream(self), []
        for lo in range(0, len(word), _BLOCK):
            out += stream.feed(word[lo : lo + _BLOCK])
        return pack(out + stream.finish())

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        stream, text = TextStream(self), text or ""
        return b"".join(stream.feed(text[lo : lo + _PIECE]) for lo in range(0, len(text), _PIECE)) + stream.finish()

    # --- decoding

    def decoded(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, in pieces, through the machine.  Without a decoder the file asks for the tokens' own text, joined by spaces."""
        machine, raw, ids, between = Utf8Machine(), self.raw, iter(ids), b"" if self.byte_level else b" "
        lead = b""
        while some := list(itertools.islice(ids, _BLOCK)):
            if held := [raw[i] for i in some if i in raw]:
                yield machine.feed(lead + between.join(held))
                lead = between
        yield machine.finish()


_NONE = 1 << 60


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordStream:
    """Merges one word fed in pieces; keeps the lookahead and a stride of symbols.

    Dropping what was emitted is sound: no merge crossed the cut, so what follows merges by itself as it did before.
    """

    def __init__(self, tok: Tokenizer):
        self.tok, self.held, self.final = tok, [], None

    def feed(self, text: str) -> list[int]:
        data, out, inner, most = text.encode("utf-8", "surrogatepass"), [], self.tok.inner, self.tok.ahead + _STRIDE
        if not data:
            return out
        if self.final is not None:
            self.held.append(inner[self.final])
        self.final = data[-1]  # it may be the word's last byte, whose symbol differs
        for lo in range(0, len(data) - 1, _STRIDE):
            self.held += [inner[b] for b in data[lo : min(lo + _STRIDE, len(data) - 1)]]
            if len(self.held) >= most:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Emit what the lookahead settles: the tokens that end before the last symbols that can still decide on them."""
        merged, used, n = self.tok.merge(list(self.held)), 0, 0
        limit = len(self.held) - self.tok.ahead
        for t in merged:
            if used + self.tok.length[t] > limit:
                break
            used += self.tok.length[t]
            n += 1
        del self.held[:used]
        return merged[:n]

    def finish(self) -> list[int]:
        if self.final is None:
            return []
        out = self.tok.merge([*self.held, self.tok.last[self.final]])
        self.held, self.final = [], None
        return out


_LETTERS, _OTHERS = regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*")


class TextStream:
    """Encodes a text fed in pieces: special strings, normalisation, pre-tokens, merges; constant memory."""

    def __init__(self, tok: Tokenizer):
        self.tok, self.raw, self.ready = tok, "", ""
        self.open: tuple[regex.Pattern, WordStream] | None = None

    def feed(self, piece: str) -> bytes:
        self.raw += piece
        return self._take(self._safe(len(self.raw) - self.tok.longest_special), False) if len(self.raw) > _PIECE else b""

    def finish(self) -> bytes:
        return self._take(len(self.raw), True)

    def _safe(self, end: int) -> int:
        """The last cut before ``end`` that neither normalisation nor a special string reaches across; 0 if none."""
        while end > 0 and not _starts_afresh(self.raw[end]):
            end -= 1
        for m in self.tok.split_special.finditer(self.raw):
            if m.start() < end < m.end():
                return m.start()
        return max(end, 0)

    def _take(self, end: int, last: bool) -> bytes:
        out, text, at = [], self.raw[:end], 0
        self.raw = self.raw[end:]
        for m in self.tok.split_special.finditer(text):
            out += [self._words(text[at : m.start()], True), pack([self.tok.special[m.group()]])]
            at = m.end()
        out.append(self._words(text[at:], last))
        return b"".join(out)

    def _words(self, text: str, last: bool) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing goes letter by letter
        text, out, tok = self.ready + text.lower(), [], self.tok
        self.ready = ""
        if self.open:
            run = self.open[0].match(text)
            end = run.end() if last or run.end() < len(text) else max(0, run.end() - 3)
            out.append(pack(self.open[1].feed(text[:end])))
            if not last and run.end() == len(text):
                self.ready = text[end:]
                return b"".join(out)
            out.append(pack(self.open[1].finish()))
            self.open, text = None, text[end:]
        words = tok.words.findall(text)
        if not last and words:  # a match near the end may yet grow; a long one is fed as far as it goes
            begin = end = len(text)
            found = list(tok.words.finditer(text, max(0, text.rfind(" ", 0, max(0, len(text) - 3)))))
            found = [m for m in found if m.end() > len(text) - 3]
            if found:
                begin = found[0].start()
                words = words[: len(words) - len(found)]
            rest = text[begin:end]
            out.append(self._cached(words))
            for kind in (_LETTERS, _OTHERS):
                n = kind.match(rest).end()
                if n == len(rest) > _BLOCK:
                    self.open = (kind, WordStream(tok))
                    out.append(pack(self.open[1].feed(rest[:-3])))
                    rest = rest[-3:]
                    break
            self.ready = rest
            return b"".join(out)
        out.append(self._cached(words))
        return b"".join(out)

    def _cached(self, words: list[str]) -> bytes:
        cache = self.tok.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > _CACHE:
                cache.clear()
            own: dict[str, bytes] = {}
            for w in words:
                if w not in own:
                    own[w] = cache.get(w) or self.tok.word(w)
                    if len(w) <= 64:
                        cache[w] = own[w]
            return b"".join(map(own.__getitem__, words))


def _starts_afresh(c: str) -> bool:
    """Whether normalisation surely never joins ``c`` to what precedes it."""
    return c.isascii() or unicodedata.category(c)[0] in "LN" and not "ᅠ" <= c <= "ᇿ"


class Utf8Machine:
    """Incremental bytes to text; a broken sequence becomes one replacement character for its longest valid beginning."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):  # an unfinished sequence at the end waits
            b = data[-back]
            if b >= 0xC0:
                cut -= back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
                break
            if b < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


_loaded: dict[str, Tokenizer] = {}


def load(definition: str) -> Tokenizer:
    """One tokenizer a process and file, with its bounded cache of words."""
    key = hashlib.sha1(definition.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(definition)
    return _loaded[key]


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str], text: str = "text", with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` plus ids (array<int>, if asked for), n_tokens, ids_sha256, decoded_sha256 (or the next free names); a plain map."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    types = dict(docs.dtypes)
    made = {n: free_name(n, keep) for n in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")}
    kinds = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{made[n]}` {t}" for n, t in kinds.items() if with_ids or n != "ids"])

    def run(cols):
        tok = load(shipped.value)
        new: dict[str, list] = {n: [] for n in made.values()}
        for t in cols[text]:
            packed = tok.packed(t)
            ids = np.frombuffer(packed, "<u4")
            digest = hashlib.sha256()
            for piece in tok.decoded(ids.tolist()):
                digest.update(piece.encode("utf-8", "surrogatepass"))
            if with_ids:
                new[made["ids"]].append(ids.astype(np.int32))
            new[made["n_tokens"]].append(len(ids))
            new[made["ids_sha256"]].append(hashlib.sha256(packed).hexdigest())
            new[made["decoded_sha256"]].append(digest.hexdigest())
        return {c: cols[c] for c in keep} | new

    return map_rows(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]), run, schema, slice_rows=256)
