"""Evaluation texts leaking into training text: Wu-Manber search for many short strings, then alignment of whole items.

Texts become streams of canonical letters: case, marks, spaces, digits and mark-up go, accents and look-alike letters of
other alphabets fold. The test strings are windows of the items' streams, STRIDE letters apart, so an unchanged run of
LENGTH + STRIDE - 1 letters of an item always holds one. A table of shifts by blocks of BLOCK letters says how far the
search may jump; a block with shift 0 selects, by the hash of the strings' last block, the strings that may end there;
their first letters and then all letters are compared. Many cursors run through a batch at once, so each step is one
vector operation. A second way to the alignment needs no long runs: CHAIN whole words of an item in its order, not far from
each other in either text, so passages in which every second or third word was changed are aligned too. A document that
covers enough letters of an item, or holds such a chain, is then aligned with it word by word: it leaks if one passage, the
best local alignment of words (Smith-Waterman), has at least a third of the item's words and ten, changed single words included.

Every character of every document is searched; the items are a stated query set, searched in blocks of BLOCK_CHARS characters.

Defined results: null and empty texts leak nothing; items shorter than ten words cannot leak; repeated documents and items
each give rows; an item's instruction line (up to a colon, before any end of sentence) does not count.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, BLOCK, STRIDE, PREFIX = 14, 8, 4, 4
#: Bits of the block hash.
BITS = 20
#: Letters of an item that the strings found in a document must cover before it is aligned, where no chain of words is found.
COVER = 34
#: Equal words in order that make a chain, of which each may be REACH words from the next.
CHAIN, REACH = 3, 8
#: Of NEAR words around a chain so many must be like words of the item at that place, give or take DRIFT words.
NEAR, LIKE, DRIFT = 12, 5, 4
#: A word in more items than this, and than this share of them, starts no chain.
COMMON, COMMON_SHARE = 30, 0.1
#: A leak has so many of the item's words, and this share of them.
SHARE, WORDS = 1 / 3, 10
#: What an equal word gains, what an alike one does (next to nothing, as many words of a language are alike), and what a changed,
#: added or left out one costs. Words are alike if they share half of their pairs of letters, found in sets of HASHED bits; two
#: words are written as one if three quarters are shared.
EQUAL, ALIKE, COST, HASHED = np.int16(10), np.int16(1), np.int16(7), 128
#: Words of document parts that are aligned together.
TOGETHER = 1 << 15
#: Letters in a slice, letters per cursor.
SLICE, LANE = 1 << 20, 256
#: Characters of the items of one block: a larger query set is searched block by block.
BLOCK_CHARS = 20_000_000

_LATIN, _GREEK, _ALIKE = "abcehkmoptxy", "αβεηκμορτχυν", "авсенкмортху"
_ALIKE_OF = {**dict(zip("aceopxykmth", "асеорхукмтн", strict=True)), "b": "в"}
_GREEK_OF = dict(zip("αβεηικμνορτυχ", "авенікмvортух", strict=True))
_ATTRIBUTE = r"""\s++[A-Za-z_:][\w:.-]*+(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>=`]++))?+"""
#: Tags with their attributes, entities, notes of one word and number in brackets, targets of links; of any length.
_TAG = re.compile(rf"</?+[A-Za-z][A-Za-z0-9:-]*+(?:{_ATTRIBUTE})*+\s*+/?+>|&[A-Za-z][A-Za-z0-9]*+;|&#x?+[0-9A-Fa-f]++;|\[\w*+[.,]?+\s?+\d*+\](?!\()|\]\([^()\s]*+\)")


def _fold(c: str) -> str:
    """The canonical letter of a character; empty if it is none."""
    base = unicodedata.normalize("NFKD", c)[:1].lower()
    base = {**_ALIKE_OF, **_GREEK_OF}.get(base, base)
    base = {"ѕ": "s", "ј": "j", "һ": "h", "і": "i", "ԁ": "d"}.get(base, base)
    return base if base and unicodedata.category(base)[0] == "L" else ""


def letter_table() -> np.ndarray:
    """The code (1 to 255) of every character's canonical letter; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint8)
    # Letters of the Russian and the Latin alphabet have codes of their own; rarer ones may share theirs.
    own = dict.fromkeys(_fold(c) for c in map(chr, [*range(0x430, 0x450), *range(0x61, 0x7B)]))
    codes = {f: i for i, f in enumerate(filter(None, own), 1)}
    base = len(codes) + 1
    for cp in [*range(0x41, 0x600), *range(0x1E00, 0x2000), *range(0x2C60, 0x2C80), *range(0xA640, 0xA6A0), *range(0xFF21, 0xFF5B)]:
        f = _fold(chr(cp))
        if f:
            table[cp] = codes.setdefault(f, base + len(codes) % (128 - base))
    rest = np.arange(0x0600, 0x30000)
    letters = np.array([unicodedata.category(chr(c))[0] == "L" for c in rest])
    blank = table[rest] == 0
    table[rest[letters & blank]] = 128 + rest[letters & blank] % 127
    return table


def without_markup(text: str) -> str:
    """The text without tags, entities and bracketed notes."""
    return _TAG.sub("", text) if "<" in text or "[" in text or "&" in text else text


def without_instruction(text: str) -> str:
    """The item without a leading instruction line that ends in a colon."""
    m = re.match(r"\s*+[^:.!?…\n]++:\s++", text)
    return text[m.end() :] if m else text


_INVISIBLE = dict.fromkeys(map(ord, "\xad​‌‍‎‏⁠﻿"), "")


_WORD = re.compile(r"[^\W\d_](?:[^\W_]|[\u0300-\u036f])*(?:[-\u2010\u2011\uff0d][^\W_](?:[^\W_]|[\u0300-\u036f])*)*")
#: Characters of ordinary text, which need no normal form.
_USUAL = re.compile(r"[\x00-\x7e\u0401\u0410-\u0451\u00ab\u00bb\u2012-\u2026]*+")


def _raw_words(text: str) -> list[str]:
    plain = without_markup(text)
    if not _USUAL.fullmatch(plain):
        plain = unicodedata.normalize("NFKD", plain.translate(_INVISIBLE))
    return _WORD.findall(plain.lower())


@lru_cache(maxsize=1 << 17)
def _canonical(word: str) -> str:
    return "".join(map(_folded, word))


def folded_words(text: str) -> list[str]:
    """Words (with their hyphens) in canonical letters."""
    return [f for w in _raw_words(text) if (f := _canonical(w))]


_memo: dict[str, str] = {}


def _folded(c: str) -> str:
    if c not in _memo:
        _memo[c] = _fold(c)
    return _memo[c]


class Search:
    """The tables of the search over the items."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.table = letter_table()
        self.ids = [i for i, _ in items]
        texts = [without_instruction(t or "") for _, t in items]
        self.words = [folded_words(t) for t in texts]
        streams = [self.stream([without_markup(t)])[0] for t in texts]
        at, of, pos = [], [], []
        self.length = np.array([len(s) for s in streams], np.int64)
        base = 0
        for k, s in enumerate(streams):
            n = len(s) - 1  # Each stream ends in a 0.
            starts = list(range(0, n - LENGTH + 1, STRIDE))
            if n >= LENGTH and starts[-1] != n - LENGTH:
                starts.append(n - LENGTH)
            at += [base + p for p in starts]
            of += [k] * len(starts)
            pos += starts
            base += len(s)
        self.letters = np.concatenate(streams) if streams else np.zeros(0, np.uint8)
        self.at, self.of, self.pos = np.array(at, np.int64), np.array(of, np.int32), np.array(pos, np.int32)
        self.shift = np.full(1 << BITS, LENGTH - BLOCK + 1, np.uint8)
        if len(self.at):
            codes = self.block_codes(self.pack(self.letters), np.arange(len(self.letters)))
            for j in range(LENGTH - BLOCK + 1):
                np.minimum.at(self.shift, codes[self.at + j], LENGTH - BLOCK - j)
            last = codes[self.at + LENGTH - BLOCK]
            order = np.argsort(last, kind="stable")
            self.at, self.of, self.pos, last = self.at[order], self.of[order], self.pos[order], last[order]
            self.bucket = np.searchsorted(last, np.arange((1 << BITS) + 1)).astype(np.int32)
            self.prefix = self.pack(self.letters)[self.at]
        self.bare = np.array([unicodedata.category(chr(c)) in ("Mn", "Me", "Cf") for c in range(0x10000)] + [False])
        self.mix = np.random.default_rng(7).integers(1, 1 << 63, (64, 256), np.uint64)
        self.signed: dict[int, Signed] = {}
        self._index_words([without_markup(t) for t in texts])

    def _index_words(self, texts: list[str]) -> None:
        """The places (item, word) of each word that is not common, by the hash of the word."""
        hashes, of, _, _, ends = self.hashed_words(texts)
        self.item_keys = np.stack([hashes, *ends])
        self.item_first = np.searchsorted(of, np.arange(len(texts) + 1))
        pos = np.arange(len(of)) - np.searchsorted(of, of)
        known, inverse = np.unique(hashes, return_inverse=True)
        pairs = np.unique(inverse.astype(np.int64) * (len(texts) + 1) + of)
        in_items = np.bincount(pairs // (len(texts) + 1), minlength=len(known))
        kept = in_items[inverse] <= max(COMMON, COMMON_SHARE * len(texts))
        order = np.flatnonzero(kept)
        order = order[np.argsort(hashes[order], kind="stable")]
        self.place_item, self.place_word = of[order].astype(np.int32), pos[order].astype(np.int32)
        self.place_hash, self.place_first, self.place_size = np.unique(hashes[order], return_index=True, return_counts=True)

    def hashed_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each run of letters: its hash in canonical letters, its text, its first and last character in the joined texts, and
        its first and its last letters (the hash again where it is too short)."""
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.table[points]
        at = np.flatnonzero((codes > 0) | ~self.bare[np.minimum(points, 0x10000)])
        codes = codes[at]
        letter = codes > 0
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        last = letter.copy()
        last[:-1] &= ~letter[1:]
        begin, end = np.flatnonzero(first), np.flatnonzero(last)
        if not len(begin):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), begin, end, [np.zeros(0, np.uint64)] * 2
        inside = np.flatnonzero(letter)
        size = end - begin + 1
        offset = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
        hashes = np.add.reduceat(self.mix[offset & 63, codes[inside]], np.cumsum(size) - size)
        packs = self.pack(codes)
        keys = [np.where(size > PREFIX, packs[begin], hashes), np.where(size > PREFIX, packs[np.maximum(end - PREFIX + 1, 0)], hashes)]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        return hashes, np.searchsorted(ends, at[begin]), at[begin], at[end], keys

    def _alike_around(self, keys: np.ndarray, text: np.ndarray, word: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The most words among NEAR around each given word that are like a word of the item at that place."""
        best = np.zeros(len(word), np.int64)
        for x in range(0, len(word), 1 << 14):
            w, i, g = word[x : x + (1 << 14)], item[x : x + (1 << 14)], self.item_first[item[x : x + (1 << 14)]] + place[x : x + (1 << 14)]
            like = np.zeros((len(w), 2 * NEAR + 1), np.int64)
            for d in range(-NEAR, NEAR + 1):
                at = np.clip(w + d, 0, len(text) - 1)
                some = np.zeros(len(w), bool)
                for e in range(d - DRIFT, d + DRIFT + 1):
                    to = np.clip(g + e, self.item_first[i], self.item_first[i + 1] - 1)
                    some |= (keys[:, at] == self.item_keys[:, to]).any(axis=0) & (to == g + e)
                like[:, d + NEAR] = some & (at == w + d) & (text[at] == text[w])
            total = np.cumsum(np.pad(like, ((0, 0), (1, 0))), axis=1)
            best[x : x + (1 << 14)] = (total[:, NEAR:] - total[:, :-NEAR]).max(axis=1)
        return best

    def chained(self, plain: list[str]) -> list[tuple[int, int, str]]:
        """(text, item, part of the text) where CHAIN words of the item stand in order and near each other."""
        hashes, text, begin, end, keys = self.hashed_words(plain)
        if not len(hashes) or not len(self.place_hash):
            return []
        k = np.minimum(np.searchsorted(self.place_hash, hashes), len(self.place_hash) - 1)
        hit = np.flatnonzero(self.place_hash[k] == hashes)
        first, size = self.place_first[k[hit]], self.place_size[k[hit]]
        word = np.repeat(hit, size)
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(word))
        item = self.place_item[place]
        order = np.argsort(item.astype(np.uint16) if len(self.ids) < 1 << 16 else item, kind="stable")
        word, item, place = word[order].astype(np.int32), item[order], self.place_word[place[order]]
        links, lag, reach = [], 0, word.astype(np.int64) + (item.astype(np.int64) * (len(hashes) + 2 * REACH))
        while lag + 1 < len(word):
            lag += 1
            # Hits are in the order of items and words, so beyond the first lag without hits in reach there are none.
            close = np.flatnonzero(reach[lag:] - reach[:-lag] <= REACH)
            if not len(close):
                break
            dw, dp = word[close + lag] - word[close], place[close + lag] - place[close]
            near = close[(dw > 0) & (dp > 0) & (dp <= REACH)]
            near = near[text[word[near]] == text[word[near + lag]]]
            links.append((near, near + lag))
        if not links:
            return []
        source, target = np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])
        # Where chains of one more link end, until they are long enough.
        ends = np.unique(target)
        for _ in range(CHAIN - 2):
            held = np.zeros(len(word), bool)
            held[ends] = True
            ends = np.unique(target[held[source]])
        ends = ends[self._alike_around(np.stack([hashes, *keys]), text, word[ends].astype(np.int64), item[ends], place[ends]) >= LIKE]
        at = np.cumsum([0, *(len(t) + 1 for t in plain)])
        out, upto = [], {}
        for j in ends.tolist():
            w, i = int(word[j]), int(item[j])
            t = int(text[w])
            if upto.get((t, i), -1) >= w:
                continue
            # The part reaches as far as any passage with this chain, and ends with the text.
            far = int((1 + EQUAL / COST) * len(self.words[i])) + 1
            lo, hi = max(0, w - far), min(len(hashes) - 1, w + far)
            while text[lo] != t:
                lo += 1
            while text[hi] != t:
                hi -= 1
            upto[t, i] = w + far // 2
            out.append((t, i, plain[t][int(begin[lo]) - int(at[t]) : int(end[hi]) - int(at[t]) + 1]))
        return out

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters of texts, each text followed by a 0; where each text begins; which character each letter was."""
        codes = self.table[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kept = codes > 0
        kept[ends] = True
        at = np.flatnonzero(kept)
        return codes[at], np.concatenate([[0], np.searchsorted(at, ends[:-1]) + 1]).astype(np.int64), at

    @staticmethod
    def pack(letters: np.ndarray) -> np.ndarray:
        """Four letters from each position as one number."""
        padded = np.concatenate([letters, np.zeros(PREFIX, np.uint8)]).astype(np.uint32)
        n = len(letters)
        return padded[:n] | padded[1 : n + 1] << 8 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 24

    @staticmethod
    def block_codes(packs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of the BLOCK letters from each position."""
        second = packs[np.minimum(at + PREFIX, len(packs) - 1)]
        h = packs[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def occurrences(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the stream, number of the string) of every occurrence."""
        none = np.zeros(0, np.int64)
        n = len(letters)
        if n < LENGTH or not len(self.at):
            return none, none
        packs = self.pack(letters)
        # A cursor stands at the last block of a window; lanes overlap by the window.
        begin = np.arange(LENGTH - BLOCK, n - BLOCK + 1, LANE)
        end = np.minimum(begin + LANE, n - BLOCK + 1)
        at, found, found_block = begin, [], []
        while len(at):
            code = self.block_codes(packs, at)
            shift = self.shift[code]
            zero = shift == 0
            if zero.any():
                found.append(at[zero])
                found_block.append(code[zero])
            at = at + np.maximum(shift, 1)
            alive = at < end
            at, end = at[alive], end[alive]
        if not found:
            return none, none
        where, code = np.concatenate(found) - (LENGTH - BLOCK), np.concatenate(found_block)
        first, upto = self.bucket[code], self.bucket[code + 1]
        size = (upto - first).astype(np.int64)
        where, first = np.repeat(where, size), np.repeat(first, size)
        string = first + np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
        same = packs[where] == self.prefix[string]
        where, string = where[same], string[same]
        for j in range(PREFIX, LENGTH):
            same = letters[where + j] == self.letters[self.at[string] + j]
            where, string = where[same], string[same]
        return where, string

    def candidates(self, texts: list[str]) -> list[tuple[int, int, str]]:
        """(text, item, part of the text) that must be aligned."""
        plain = [without_markup(t) for t in texts]
        return self.covered(plain) + self.chained(plain)

    def covered(self, plain: list[str]) -> list[tuple[int, int, str]]:
        """(text, item, part of the text) where strings close to each other cover enough of the item."""
        letters, starts, chars = self.stream(plain)
        where, string = self.occurrences(letters)
        if not len(where):
            return []
        text = np.searchsorted(starts, where, "right") - 1
        of, pos = self.of[string], self.pos[string]
        order = np.lexsort((pos, where, of, text))
        text, of, where, pos = text[order], of[order], where[order], pos[order]
        # Strings further apart than the item is long are of different passages.
        new = np.ones(len(where), bool)
        new[1:] = (text[1:] != text[:-1]) | (of[1:] != of[:-1]) | (np.diff(where) > self.length[of[1:]])
        cluster = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        order = np.lexsort((pos, cluster))
        sorted_pos = pos[order]
        step = np.where(new, LENGTH, np.minimum(np.diff(sorted_pos, prepend=0), LENGTH))
        cover = np.add.reduceat(step, first)
        last = np.concatenate([first[1:], [len(where)]]) - 1
        begin = np.cumsum([0, *(len(t) + 1 for t in plain)])
        out = []
        for c in np.flatnonzero(cover >= COVER):
            t, k = int(text[first[c]]), int(of[first[c]])
            reach = int(2.5 * self.length[k]) + 100
            lo = int(chars[where[first[c]]]) - int(begin[t]) - reach
            hi = int(chars[where[last[c]]]) - int(begin[t]) + LENGTH + reach
            out.append((t, k, plain[t][max(0, lo) : hi]))
        return out

    def leaked(self, parts: list[tuple[str, int]]) -> list[int]:
        """Of each (part of a document, item): the most words of the item that one passage of the part has in order."""
        out, order = [0] * len(parts), []
        for k, (_, item) in enumerate(parts):
            if len(self.words[item]) >= WORDS:
                order.append(k)
                if item not in self.signed:
                    self.signed[item] = Signed(self.words[item])
        words = {k: Signed(folded_words(parts[k][0])) for k in order}
        # Parts of like length are aligned together.
        order.sort(key=lambda k: words[k].n)
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * words[order[to]].n <= TOGETHER:
                to += 1
            some = order[at:to]
            for k, n in zip(some, best_passages([words[k] for k in some], [self.signed[parts[k][1]] for k in some]), strict=True):
                out[k] = n
            at = to
        return out


@lru_cache(maxsize=1 << 17)
def _signature(word: str) -> tuple[int, ...]:
    """The set of the word's pairs of letters (its ends count as letters) as HASHED bits; single letters have one pair."""
    bits = [0] * (HASHED // 64)
    for pair in {f" {word} "[i : i + 2] for i in range(len(word) + 1)}:
        h = zlib.crc32(pair.encode()) % HASHED
        bits[h // 64] |= 1 << (h % 64)
    return tuple(bits)


class Signed:
    """Words as sets of bits: each word, and each with the next one (as one word); and how many bits each has."""

    def __init__(self, words: list[str]) -> None:
        self.n = len(words)
        self.single = np.array([_signature(w) for w in words], np.uint64).reshape(self.n, -1)
        # But for three pairs at the cut these are the pairs of both words written as one.
        self.double = self.single[:-1] | self.single[1:]
        self.sizes = [np.bitwise_count(x).sum(axis=1, dtype=np.int16) for x in (self.single, self.double)]


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.bitwise_count(a[:, None, 0] & b[None, :, 0]).astype(np.int16)
    for k in range(1, a.shape[1]):
        both += np.bitwise_count(a[:, None, k] & b[None, :, k])
    return both


def _compared(words: Signed, item: Signed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each word of the document gains with each of the item; which is two of the item's as one; which are, with the word before, one."""
    both = _shared_bits(words.single, np.concatenate([item.single, item.double]))
    total = words.sizes[0][:, None] + np.concatenate(item.sizes)[None, :]
    gains = np.where(2 * both[:, : item.n] == total[:, : item.n], EQUAL, np.where(4 * both[:, : item.n] >= total[:, : item.n], ALIKE, -COST)).astype(np.int16)
    other = gains < EQUAL
    # A word that is equal by itself is not one with its neighbour.
    cut = (8 * _shared_bits(words.double, item.single) >= 3 * (words.sizes[1][:, None] + item.sizes[0][None, :])) & other[:-1] & other[1:]
    return gains, (8 * both[:, item.n :] >= 3 * total[:, item.n :]) & other[:, :-1] & other[:, 1:], cut


def best_passages(words: list[Signed], items: list[Signed]) -> list[int]:
    """Of each pair: words of the item in the best local alignment (Smith-Waterman) with the document's words, changed ones included.

    Equal words, alike ones a little, and two words written as one or one as two, gain; changed, added and left out ones cost. A row of
    all tables is computed at once: a running maximum carries the costs of words left out along it. Beyond a pair's words nothing gains."""
    size, n, m = len(words), max(w.n for w in words), max(i.n for i in items)
    least = np.int16(-1000)
    one = np.full((n, size, m), least, np.int16)
    joined, cut = np.zeros((n, size, m), bool), np.zeros((n, size, m), bool)
    for k, (w, i) in enumerate(zip(words, items, strict=True)):
        one[: w.n, k, : i.n], joined[: w.n, k, 1 : i.n], cut[1 : w.n, k, : i.n] = _compared(w, i)
    some_joined, some_cut = joined.reshape(n, -1).any(axis=1), cut.reshape(n, -1).any(axis=1)
    at = np.arange(m + 1, dtype=np.int16)
    slope = COST * at
    above, above2 = np.zeros((size, m + 1), np.int16), np.full((size, m + 1), least, np.int16)
    held, held2 = np.zeros((size, m + 1), np.int16), np.zeros((size, m + 1), np.int16)
    best, count, rows = np.zeros(size, np.int16), np.zeros(size, np.int16), np.arange(size)
    for i in range(n):
        row, kept = above - COST, held.copy()
        offers = [(1, above[:, :-1] + one[i], held[:, :-1])]
        if some_joined[i]:
            offers.append((2, np.where(joined[i][:, 1:], above[:, :-2] + np.int16(2 * EQUAL), least), held[:, :-2] + np.int16(1)))
        if some_cut[i]:
            offers.append((1, np.where(cut[i], above2[:, :-1] + EQUAL, least), held2[:, :-1]))
        for first, score, n_words in offers:
            better = score > row[:, first:]
            np.copyto(row[:, first:], score, where=better)
            np.copyto(kept[:, first:], n_words + np.int16(1), where=better)
        some = row > 0
        row *= some
        kept *= some
        row += slope
        top = np.maximum.accumulate(row, axis=1)
        source = np.maximum.accumulate(np.where(row == top, at, np.int16(0)), axis=1)
        top -= slope
        above2, held2, above, held = above, held, top, kept[rows[:, None], source]
        k = top.argmax(axis=1)
        here, words_here = top[rows, k], held[rows, k]
        more = (here > best) | (here == best) & (words_here > count)
        best[more], count[more] = here[more], words_here[more]
    return count.tolist()


def enough(n: int, item_words: int) -> bool:
    """Whether n words in a passage make a leak of an item."""
    return n >= max(WORDS, SHARE * item_words)


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, each read by itself."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-size // BLOCK_CHARS) or 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in items.select("item_id", "text").filter(of == k).orderBy("item_id", "text").collect()]


def find_leaks(documents: DataFrame, items: DataFrame, keep_all: bool = False) -> DataFrame:
    """(doc_id, item_id, n_words, item_words) of each leak; with keep_all of each aligned candidate. The tables of the search are
    built once for each block of items, broadcast, and kept by the workers."""
    sc = documents.sparkSession.sparkContext
    kinds = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    rows = documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text")

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            search = shared.value
            for batch in batches:
                ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
                out, at = [], 0
                while at < len(texts):
                    to, held = at, 0
                    while to < len(texts) and (held == 0 or held + len(texts[to]) <= SLICE):
                        held += len(texts[to])
                        to += 1
                    best: dict[tuple[int, int], int] = {}
                    found = search.candidates(texts[at:to])
                    for (text, item, _), n in zip(found, search.leaked([(part, item) for _, item, part in found]), strict=True):
                        best[text, item] = max(best.get((text, item), 0), n)
                    for (text, item), n in best.items():
                        of = len(search.words[item])
                        if keep_all or enough(n, of):
                            out.append((ids[at + text], search.ids[item], n, of))
                    at = to
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "item_words"])

        return rows.mapInPandas(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int, item_words int")

    return reduce(DataFrame.unionAll, [searched(sc.broadcast(Search(block))) for block in _blocks(items)])
