"""Garbled text from a wrong character encoding: found and restored with a hidden Markov model.

States: clean text, one state per encoding pair (bytes of one encoding decoded as another, also twice), and lost text
(letters that became question marks or replacement characters). Each state emits a character given the one before it; the
probabilities are trained by garbling all ordinary documents, and text made up from the alphabets of other languages and from
signs, in each state's way. Viterbi labels characters, and each labelled span gets its state's inverse transform.

Ordinary documents are those of PLAIN characters only; each counts, as a whole. They need not be garbled one by one: every
state writes each character in one way, so the pairs of characters of garbled text follow from the pairs of the text. Executors
count those, and the pairs that arise where a state drops characters (Pairs); the driver gets sums alone.

Most texts need no Viterbi: leaving and re-entering the clean state costs a fixed amount, so a path can only leave it where
the summed gain of the best garbled state over the clean one exceeds that amount somewhere. That bound (a running sum less
its running minimum) is exact, covers every character of every text, and is computed for whole batches at once; Viterbi
runs on the stretches that pass it.

Defined results: null and empty texts are clean; texts are handled whole, whatever their length; repeated rows each give a
result; characters that were lost stay lost; other columns are ignored. The table is read twice, to train and to search.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slovotok.llm import plaintext

#: Nats that a path pays to leave the clean state, and to come back.
ENTER, LEAVE = 9.0, 4.0
#: The same for a state of a pair of encodings that is seldom met.
ENTER_RARE = 17.0
#: The same for a state whose garbled text is Cyrillic letters too, as a misspelling may look like it.
ENTER_LETTERS = 13.0
#: Characters of a slice in which pairs are counted and the bound is computed.
SLICE = 1 << 19
#: A span is mended in parts of fewer characters.
PIECE = 400

WRONG = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "mac-roman", "cp437", "cp1250")
PAIRS = {
    "utf-8": WRONG,
    "cp1251": ("cp1252", "latin-1", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "mac-roman", "cp437"),
    "koi8-r": ("cp1252", "latin-1", "cp1251", "cp866", "iso8859-5", "mac-cyrillic", "mac-roman", "cp437"),
    "cp866": ("cp1252", "latin-1", "cp1251", "koi8-r", "mac-cyrillic", "mac-roman", "cp437"),
    "iso8859-5": ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866"),
    "mac-cyrillic": ("cp1252", "cp1251", "koi8-r", "cp866"),
    "cp1252": ("cp1251", "koi8-r", "cp866", "mac-cyrillic", "mac-roman", "cp437"),
}
TWICE = (("cp1251", "cp1251"), ("cp1252", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("latin-1", "latin-1"), ("koi8-r", "koi8-r"), ("cp866", "cp866"))

#: Encodings of single bytes that text is garbled from.
SINGLE = tuple(t for t in PAIRS if t != "utf-8")

#: What the made text of one language, and of one kind of signs, weighs against the documents.
LANGUAGE_SHARE, SIGNS_SHARE = 0.004, 0.03
#: Every language's text is garbled with so many of its characters to train the garbled states.
LANGUAGE_CHARS = 1_500
_CAPITALS = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"
#: The characters of ordinary documents.
PLAIN = "".join(map(chr, (10, *range(0x20, 0x7F), *range(0x410, 0x450)))) + "Ёё«»—–…№•→"
#: What all documents weigh once more in capitals, with stress marks, and with look-alikes (one of three letters, all, one of three capitals).
CAPITALS_SHARE, STRESSED_SHARE, ALIKE_SHARE, ALL_ALIKE_SHARE, ALIKE_CAPITALS_SHARE = 0.03, 0.03, 0.04, 0.01, 0.01


@lru_cache(maxsize=32)
def _decoding(name: str) -> tuple[str, ...]:
    """The character of each byte; bytes that the encoding leaves undefined are control characters."""
    return tuple(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


@lru_cache(maxsize=32)
def _encoding(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_decoding(name))))}


@lru_cache(maxsize=32)
def _charmap(name: str):
    return codecs.charmap_build("".join(_decoding(name)))


def _to_bytes(text: str, name: str) -> bytes:
    """The bytes of a text; what the encoding lacks becomes a question mark."""
    return text.encode("utf-8", "replace") if name == "utf-8" else codecs.charmap_encode(text, "replace", _charmap(name))[0]


def garble(text: str, true: str, wrong: str) -> str:
    """What text looks like when its bytes in the true encoding are read in the wrong one."""
    return codecs.charmap_decode(_to_bytes(text, true), "strict", "".join(_decoding(wrong)))[0]


def restore_once(text: str, true: str, wrong: str) -> str:
    """The inverse of garble; what the wrong encoding does not have stays as it is."""
    table, out, run = _encoding(wrong), [], bytearray()
    for c in text:
        if c in table:
            run.append(table[c])
        else:
            out += [bytes(run).decode(true, "replace"), c]
            run.clear()
    return "".join([*out, bytes(run).decode(true, "replace")])


def states() -> list[tuple[str, tuple[tuple[str, str], ...]]]:
    """Name and garbling steps (true, wrong) of each state after the clean one; lost text has no steps."""
    out = [(f"{t}>{w}", ((t, w),)) for t, wrongs in PAIRS.items() for w in wrongs]
    out += [(f"utf-8>{a}>{b}", (("utf-8", a), ("utf-8", b))) for a, b in TWICE]
    return [*out, ("lost:?", ()), ("lost:\ufffd", ())]


def enter_costs() -> list[float]:
    """What entering each state costs, the clean one first."""
    seldom = lambda t, w: t in ("mac-cyrillic", "iso8859-5", "cp1252") or t != "utf-8" and w in ("mac-roman", "cp437", "iso8859-5", "mac-cyrillic")
    letters = lambda t, w: t != "utf-8" and w in ("cp1251", "koi8-r", "cp866")
    return [0.0, *(ENTER if len(s) != 1 else ENTER_RARE if seldom(*s[0]) else ENTER_LETTERS if letters(*s[0]) else ENTER for _, s in states())]


def _count(texts: list[tuple[str, float]], lookup: np.ndarray, size: int) -> np.ndarray:
    m = np.zeros(size * size)
    for text, weight in texts:
        ids = lookup[np.frombuffer(("\n" + text).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        m += np.bincount(ids[:-1] * size + ids[1:], minlength=size * size) * weight
    return m.reshape(size, size)


_ASCII = frozenset(map(chr, range(127)))
_WESTERN = _ASCII | set(_decoding("cp1252"))
#: Characters are lost in a conversion to ASCII, or to the encoding of Western Europe, which has quotation marks and dashes.
LOST = ((_ASCII, 0.7), (_WESTERN, 0.3))


def _log_table(m: np.ndarray, floor: float) -> np.ndarray:
    """Bigram log probabilities, smoothed by unigrams (Witten-Bell, a thirtieth at least) and a floor."""
    n, d = m.sum(1, keepdims=True), (m > 0).sum(1, keepdims=True)
    uni = m.sum(0)
    uni = 0.999 * uni / max(uni.sum(), 1) + 0.001 * floor
    lam = np.minimum(n / np.maximum(n + d, 1), 0.97)
    return np.log(lam * m / np.maximum(n, 1) + (1 - lam) * uni[None, :] + 1e-9)


class Model:
    """The trained model: alphabet, log probabilities of each state (clean first), groups of states for the bound."""

    def __init__(self, alphabet: str, tables: np.ndarray, groups: list[list[int]]) -> None:
        self.alphabet, self.tables, self.groups = alphabet, tables, groups
        self.size = len(alphabet) + 1
        self.lookup = np.zeros(0x110000, np.uint16)
        self.lookup[[ord(c) for c in alphabet]] = np.arange(1, self.size)
        self.gains = [(tables[g].max(0) - tables[0]).astype(np.float32).ravel() for g in groups]
        self.enter = enter_costs()
        self.limits = [min(self.enter[k] for k in g) + LEAVE for g in groups]
        self.names = ["clean", *(n for n, _ in states())]
        self.steps = [(), *(s for _, s in states())]

    def packed(self) -> tuple[str, tuple[int, ...], bytes, list[list[int]]]:
        """A small form for the executors; probabilities are rounded to a tenth of a nat."""
        q = np.clip(np.round(self.tables * -10), 0, 255).astype(np.uint8)
        return self.alphabet, q.shape, zlib.compress(q.tobytes(), 3), self.groups

    @staticmethod
    def unpacked(packed: tuple[str, tuple[int, ...], bytes, list[list[int]]]) -> Model:
        alphabet, shape, data, groups = packed
        return Model(alphabet, np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape).astype(np.float32) / -10, groups)

    def stretches(self, text: str, starts: np.ndarray) -> list[tuple[int, int]]:
        """Where a path may leave the clean state: (from, to) in characters. `starts` are the first characters of texts.

        Removing a segment of one garbled state from the best path saves its ENTER + LEAVE, so each has a gain above that in its
        own state, hence in its state's group; no prefix of it has a negative gain. The union of the groups' stretches holds it.
        """
        ids = self.lookup[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        if not len(ids):
            return []
        pair = np.empty_like(ids)
        pair[1:] = ids[:-1]
        pair[0] = pair[starts] = int(self.lookup[10])
        pair *= self.size
        pair += ids
        inside = None
        for gain, limit in zip(self.gains, self.limits, strict=True):
            s = gain[pair].astype(np.float64)
            s[starts] -= 1e4  # A path starts afresh in each text, also just before its first character.
            np.cumsum(s, out=s)
            base = np.empty_like(s)
            base[0] = -1e4
            base[1:] = s[:-1]
            base[starts[1:]] -= 1e4
            np.minimum.accumulate(base, out=base)
            s -= base
            if s.max() <= limit:
                continue
            hits = np.flatnonzero(s > limit)
            on = s > 0
            on[starts] = False
            edge = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
            runs = edge.reshape(-1, 2)
            took = np.unique(np.searchsorted(runs[:, 0], hits, "right") - 1)
            inside = np.zeros(len(s), bool) if inside is None else inside
            for a, b in runs[took[took >= 0]]:
                # The character before may be the first of its text or of the segment: include it.
                inside[max(0, a - 1) : b] = True
        if inside is None:
            return []
        out = []
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        for a, b in edge:
            cuts = starts[np.searchsorted(starts, a, "right") : np.searchsorted(starts, b, "left")]
            bounds = [int(a), *map(int, cuts), int(b)]
            out += list(zip(bounds, bounds[1:]))
        return out

    def label(self, text: str, before: str) -> np.ndarray:
        """The state of each character of a stretch that begins and ends next to clean text (Viterbi)."""
        ids = self.lookup[np.frombuffer(((before or "\n") + text).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        n = len(ids) - 1
        own = []
        clean = self.tables[0][ids[:-1], ids[1:]]
        for k in range(1, len(self.tables)):
            s = np.cumsum(self.tables[k][ids[:-1], ids[1:]].astype(np.float64) - clean)
            low = np.minimum.accumulate(np.concatenate([[0.0], s[:-1]]))
            if (s - low).max() > self.enter[k] + LEAVE:
                own.append(k)
        path = np.zeros(n, np.int16)
        if not own:
            return path
        emit = [(self.tables[k][ids[:-1], ids[1:]] - clean).tolist() for k in own]
        kept = range(len(own))
        cost = [self.enter[k] for k in own]
        score, best_clean = [e[0] - c for e, c in zip(emit, cost, strict=True)], 0.0
        back_clean, back = [-1] * n, [[-1] * n for _ in kept]
        for i in range(1, n):
            best = max(kept, key=score.__getitem__)
            leave = score[best] - LEAVE
            new = []
            for k in kept:
                v, come = score[k], k
                if best_clean - cost[k] > v:
                    v, come = best_clean - cost[k], -1
                if leave - cost[k] > v:
                    v, come = leave - cost[k], best
                back[k][i] = come
                new.append(v + emit[k][i])
            if leave > best_clean:
                best_clean, back_clean[i] = leave, best
            score = new
        best = max(kept, key=score.__getitem__)
        state = best if score[best] - LEAVE > best_clean else -1
        for i in range(n - 1, -1, -1):
            path[i] = own[state] if state >= 0 else 0
            state = back[state][i] if state >= 0 else back_clean[i]
        return path

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(from, to, state) of the garbled spans of one text."""
        out = []
        for a, b in self.stretches(text, np.array([0])):
            out += self._runs(self.label(text[a:b], text[a - 1] if a else ""), a)
        return out

    @staticmethod
    def _runs(path: np.ndarray, at: int) -> list[tuple[int, int, int]]:
        edge = np.flatnonzero(np.diff(path)) + 1
        bounds = [0, *edge.tolist(), len(path)]
        return [(at + x, at + y, int(path[x])) for x, y in zip(bounds, bounds[1:]) if path[x]]

    def _inverse(self, piece: str, state: int) -> str:
        for true, wrong in reversed(self.steps[state]):
            piece = restore_once(piece, true, wrong)
        return piece

    def _pieces(self, text: str, a: int, b: int, state: int) -> list[tuple[int, int]]:
        """A span in parts of fewer than PIECE characters, cut after spaces, which no garbled character contains, if there are any."""
        out = []
        while b - a >= PIECE:
            cut = max(text.rfind(" ", a, a + PIECE - 1), text.rfind("\n", a, a + PIECE - 1)) + 1
            if cut <= a + 1:
                cut = min(range(a + PIECE - 1, a + PIECE - 9, -1), key=lambda c: self._inverse(text[a:c], state).count("\ufffd"))
            out.append((a, cut))
            a = cut
        return [*out, (a, b)]

    def _mended(self, text: str, a: int, b: int, state: int, least: int, most: int) -> tuple[str, int, int]:
        """(restored text, from, to) of a span that may be widened to least and most."""
        whole = self._inverse(text[a:b], state)
        if "\ufffd" not in whole:
            return whole, a, b
        parts, pieces = [], self._pieces(text, a, b, state)
        for p, q in pieces:
            best = self._inverse(text[p:q], state), p, q
            for k in (state, *(k for k, steps in enumerate(self.steps) if steps and steps[0][0] == "utf-8")) if "\ufffd" in best[0] else ():
                for x in range(p, (least if p == a else p) - 1, -1):
                    for y in range(q, (most if q == b else q) + 1):
                        piece = self._inverse(text[x:y], k)
                        if piece.count("\ufffd") < best[0].count("\ufffd"):
                            best = piece, x, y
            parts.append(best)
        made = "".join(p for p, _, _ in parts)
        return (made, parts[0][1], parts[-1][2]) if made.count("\ufffd") < whole.count("\ufffd") else (whole, a, b)

    def restored(self, text: str, spans: list[tuple[int, int, int]]) -> str:
        """The text with each span's inverse transform applied. Where that leaves broken characters, the span is widened by
        up to two characters, or read with the inverse of another state, if that leaves fewer; a long span piece by piece."""
        out, last = [], 0
        for a, b, state in spans:
            a = max(a, last)
            if self.steps[state] and self.steps[state][0][0] != "utf-8":
                # Between encodings of single bytes a span does not begin or end inside a word.
                while a > last and text[a - 1].isalpha() and text[a].isalpha():
                    a -= 1
                while b < len(text) and text[b].isalpha() and text[b - 1].isalpha():
                    b += 1
            best, best_a, best_b = self._mended(text, a, b, state, max(last, a - 2), min(len(text), b + 2))
            out += [text[last:best_a], best]
            last = best_b
        return "".join([*out, text[last:]])


def _worn(name: str, text: str) -> list[tuple[Callable[[str], str], float]]:
    """What happens on the way to text garbled in a state's way, with weights: nothing, or characters are lost or evened out."""
    out: list[tuple[Callable[[str], str], float]] = [(lambda t: t, 1.0)]
    if "latin-1" not in name and any("\x80" <= c <= "\x9f" for c in text):
        out += [(lambda t: "".join("\ufffd" if "\x80" <= c <= "\x9f" else c for c in t), 0.2), (lambda t: "".join(c for c in t if not "\x80" <= c <= "\x9f"), 0.2)]
    if "\xa0" in text:
        out.append((lambda t: t.replace("\xa0", " ").replace("\xad", ""), 0.2))
    return out


def _spoil(texts: list[tuple[str, float]], name: str, steps: tuple[tuple[str, str], ...]) -> list[tuple[str, float]]:
    """Made texts garbled in a state's way, also with characters lost or evened out on the way."""
    out = []
    for t, w in texts:
        if steps[0][0] != "utf-8":
            known = _encoding(steps[0][0])
            kept = "".join(c for c in t if c in known)
            if len(kept) < 0.97 * len(t) or kept.isascii():
                continue
            t = kept
        for true, wrong in steps:
            t = garble(t, true, wrong)
        out += [(f(t), share * w) for f, share in _worn(name, t)]
    return out


def _spoilt_characters(characters: str, case: Callable[[str], str], name: str, steps: tuple[tuple[str, str], ...]) -> list[tuple[list[str], float]]:
    """What each of the characters, in a case, becomes in a state's way, with weights; empty where it is dropped."""
    if name.startswith("lost:"):
        return [(["".join(x if x in kept else name[-1] for x in case(c)) for c in characters], share) for kept, share in LOST]
    out = []
    for c in characters:
        t = case(c)
        if steps[0][0] != "utf-8":
            t = "".join(x for x in t if x in _encoding(steps[0][0]))
        for true, wrong in steps:
            t = garble(t, true, wrong)
        out.append(t)
    return [([f(t) for t in out], share) for f, share in _worn(name, "".join(out))]


@lru_cache(maxsize=4)
def _drops(characters: str) -> dict[tuple[str, bytes], int]:
    """The sets of characters that states drop, as (encoding, a byte for each character), numbered."""
    out: dict[tuple[str, bytes], int] = {}
    for name, steps in states():
        if steps and steps[0][0] != "utf-8":
            for case in (str, str.upper):
                for images, _ in _spoilt_characters(characters, case, name, steps):
                    if not all(images):
                        out.setdefault((steps[0][0], bytes(not x for x in images)), len(out))
    return out


class Pairs:
    """How often one of the characters follows another in texts of nothing else, whole texts, each after a line break.

    Texts are told apart by the encodings of single bytes that can write them (97 % of their characters, and some beyond ASCII).
    For each set of characters that a state drops, the pairs that meet where it does are counted too."""

    def __init__(self, characters: str) -> None:
        self.characters, self.size = characters, len(characters) + 2
        self.lookup = np.zeros(0x110000, np.uint8 if self.size < 256 else np.uint16)
        self.lookup[[ord(c) for c in characters]] = np.arange(1, self.size - 1)
        self.drops = _drops(characters)
        self.counts = np.zeros(((1 << len(SINGLE)) + len(self.drops), self.size * self.size), np.int64)
        flags = lambda values: np.array([0, *values, 0], np.int32)
        self._beyond = flags(not c.isascii() for c in characters)
        self._unknown = [flags(c not in _encoding(e) for c in characters) for e in SINGLE]
        self._dropped = [(SINGLE.index(e), flags(d).astype(bool)) for e, d in self.drops]

    def add(self, texts: list[str]) -> None:
        """Counts the texts that have no other characters, some at a time."""
        for at, to in slices(texts):
            self._add(texts[at:to])

    def _add(self, texts: list[str]) -> None:
        # A sign before each text and after the last one, which no text contains, keeps them apart.
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        ids = self.lookup[np.frombuffer("".join(["\0\n" + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.intp)
        starts = np.cumsum(lengths) - lengths
        ids[starts] = self.size - 1
        ordinary = np.minimum.reduceat(ids, starts) > 0
        if not ordinary.any():
            return
        if not ordinary.all():
            ids, lengths = ids[np.repeat(ordinary, lengths)], lengths[ordinary]
            starts = np.cumsum(lengths) - lengths
        beyond, kinds = np.add.reduceat(self._beyond[ids], starts), np.zeros(len(starts), np.int64)
        for bit, unknown in enumerate(self._unknown):
            lacks = np.add.reduceat(unknown[ids], starts)
            kinds |= ((lengths - 2 - lacks >= 0.97 * (lengths - 2)) & (beyond > lacks)).astype(np.int64) << bit
        pair = ids * self.size
        pair[:-1] += ids[1:]
        pair[-1] += self.size - 1
        present = np.unique(kinds)
        for kind in present:
            some = pair if len(present) == 1 else pair[np.repeat(kinds == kind, lengths)]
            self.counts[kind] += np.bincount(some, minlength=self.size * self.size)
        ids = np.append(ids, self.size - 1)
        lengths[-1] += 1
        for k, (bit, dropped) in enumerate(self._dropped, 1 << len(SINGLE)):
            able = kinds >> bit & 1 > 0
            if able.any():
                out = dropped[ids] if able.all() else dropped[ids] & np.repeat(able, lengths)
                edge = np.flatnonzero(out[1:] != out[:-1])
                self.counts[k] += np.bincount(ids[edge[::2]] * self.size + ids[edge[1::2] + 1], minlength=self.size * self.size)

    def between(self, encoding: str = "utf-8", images: list[str] | None = None) -> np.ndarray:
        """Pairs in the texts that an encoding can write; of what is left where the images of characters are empty."""
        kinds = 1 << len(SINGLE)
        some = [k for k in range(kinds) if encoding == "utf-8" or k >> SINGLE.index(encoding) & 1]
        m = self.counts[some].sum(0)
        if images and not all(images):
            dropped = bytes(not x for x in images)
            at = np.array([False, *map(bool, dropped), False])
            m = m.reshape(self.size, self.size)
            m[at] = m[:, at] = 0
            m = m.ravel() + self.counts[kinds + self.drops[encoding, dropped]]
        return m.reshape(self.size, self.size)[1:-1, 1:-1]

    def written(self, images: list[list[str]], lookup: np.ndarray, size: int, encoding: str = "utf-8") -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the text in which each character is written as its image: between characters, and within images. Of several
        lists of images the next one holds for the next character, and each is where a text begins equally often."""
        m = self.between(encoding, images[0])
        a, b = np.nonzero(m)
        n, often = m[a, b] / len(images), m.sum(0) / len(images)
        ends = [np.array([[lookup[ord(x[k])] if x else 0 for x in some] for some in images], np.int64) for k in (0, -1)]
        place = ends[1][:, a] * size + np.roll(ends[0], -1, 0)[:, b]
        across = np.bincount(place.ravel(), np.tile(n, len(images)), size * size).reshape(size, size)
        within = np.zeros((size, size))
        for some in images:
            for c, x in enumerate(some):
                for y, z in zip(x, x[1:]):
                    within[lookup[ord(y)], lookup[ord(z)]] += often[c]
        return across, within


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of texts that hold no more than SLICE characters together, or of a single one."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (held == 0 or held + len(texts[to]) <= SLICE):
            held += len(texts[to])
            to += 1
        yield at, to
        at = to


def _grouped(tables: np.ndarray, base: np.ndarray) -> list[list[int]]:
    """Groups of states whose largest gain is clearly negative on ordinary text, so that one sum bounds them all."""
    often = base / max(base.sum(), 1)
    mean = lambda g: float(((tables[g].max(0) - tables[0]) * often).sum())
    groups: list[list[int]] = []
    costs = enter_costs()
    for k in sorted(range(1, len(tables)), key=lambda k: (costs[k], mean([k]))):
        for g in groups:
            if costs[g[0]] == costs[k] and mean([*g, k]) < -1.5:
                g.append(k)
                break
        else:
            groups.append([k])
    return groups


def train(texts: list[str]) -> Model:
    """Trains the model on ordinary texts of any characters."""
    pairs = Pairs("".join(sorted(set("\n".join([*texts, ""])))))
    pairs.add(texts)
    return trained(pairs)


def _typed(pairs: Pairs, lookup: np.ndarray, size: int) -> np.ndarray:
    """Pairs of the documents as they are, and as others type."""
    characters, upper = pairs.characters, [c.upper() for c in pairs.characters]
    m = np.zeros((size, size))
    for share, images in ((1.0, [list(characters)]), (CAPITALS_SHARE, [upper]), (STRESSED_SHARE, [[plaintext.stressed(c, i) for c in characters] for i in range(plaintext.STRESSED_PERIOD)])):
        m += share * sum(pairs.written(images, lookup, size))
    invisible = [lookup[ord(c)] for c in plaintext.INVISIBLE]
    for share, some, every in ((ALIKE_SHARE, characters, 3), (ALL_ALIKE_SHARE, characters, 1), (ALIKE_CAPITALS_SHARE, upper, 3)):
        across, within = pairs.written([["".join(plaintext.look_alike(x, i, every) for x in c) for c in some] for i in range(plaintext.ALIKE_PERIOD)], lookup, size)
        m += share * (within + across * (1 - 1 / plaintext.INVISIBLE_EVERY))
        for x in invisible:
            each = share / plaintext.INVISIBLE_EVERY / len(invisible)
            m[:, x] += each * across.sum(1)
            m[x] += each * across.sum(0)
    return m


def trained(pairs: Pairs) -> Model:
    """The model of the pairs of ordinary texts; of made texts, if there are none."""
    made = plaintext.languages()
    total = int(pairs.between().sum())
    if not total:
        return train([t for _, t in made])
    capitals = " ".join(a + b + a for a in _CAPITALS for b in _CAPITALS)
    russian = [plaintext.look_alikes(dict(made)["Russian"], every) for every in (1, 3)]
    others = [(t, LANGUAGE_SHARE * total / len(t)) for t in (*russian, *(t for _, t in made))] + [(t, SIGNS_SHARE * total / len(t)) for t in plaintext.drawings()]
    clean = [*others, (capitals, 0.005 * total / len(capitals))]
    short = [(t[:LANGUAGE_CHARS], LANGUAGE_SHARE * total / LANGUAGE_CHARS) for _, t in made]
    # Only these characters can come from a wrong encoding; all others are alike.
    letters = "".join(sorted({c for name in WRONG for c in _decoding(name)} | {"\ufffd"}))
    size = len(letters) + 1
    lookup = np.zeros(0x110000, np.uint16)
    lookup[[ord(c) for c in letters]] = np.arange(1, size)
    base = _count(clean, lookup, size) + _typed(pairs, lookup, size)
    tables = [_log_table(base, 1 / size)]
    tables[0][1:, 1:] = np.minimum(np.maximum(tables[0][1:, 1:], plaintext.typed_floor(letters)), plaintext.typed_ceiling(letters))
    tables[0][:, 0] = -7.0  # A character that no state knows is most likely typed as such.
    for name, steps in states():
        texts = _spoil(short, name, steps) if steps else [("".join(c if c in kept else name[-1] for c in t), w * share) for kept, share in LOST for t, w in short]
        m = _count(texts, lookup, size)
        for case, weight in ((str, 1.0), (str.upper, CAPITALS_SHARE)):
            for images, share in _spoilt_characters(pairs.characters, case, name, steps):
                m += weight * share * sum(pairs.written([images], lookup, size, steps[0][0] if steps else "utf-8"))
        t = _log_table(m, 1 / size)
        t[:, 0] = -14.0
        # What a state leaves as it is tells nothing about it.
        if steps:
            same = [i + 1 for i, c in enumerate(letters) if (steps[0][0] == "utf-8" and c.isascii()) or (steps[0][0] != "utf-8" and c in _encoding(steps[0][0]) and garble(c, *steps[0]) == c)]
        else:
            same = [i + 1 for i, c in enumerate(letters) if c.isascii() and c != name[-1]]
        at = np.ix_([0, *same], [0, *same])
        t[at] = np.minimum(t[at], tables[0][at]) - 0.1
        tables.append(t)
    stacked = np.stack(tables).astype(np.float32)
    return Model(letters, stacked, _grouped(stacked, base))


def counted(documents: DataFrame) -> Pairs:
    """The pairs of characters of all ordinary documents, counted where they are; counts alone are sent and summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = Pairs(PLAIN)
        for batch in batches:
            pairs.add(batch["text"].tolist())
        counts = pairs.counts.ravel()
        place = np.flatnonzero(counts)
        yield pd.DataFrame({"place": place, "n": counts[place]})

    rows = documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("text")
    sums = rows.mapInPandas(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    pairs = Pairs(PLAIN)
    pairs.counts.ravel()[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return pairs


def garbled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, encodings, n_garbled, restored) of each text with a garbled span."""
    packed = (model or trained(counted(documents))).packed()
    shared = documents.sparkSession.sparkContext.broadcast(packed)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.unpacked(shared.value)
        for batch in batches:
            found = []
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for at, to in slices(texts):
                some = texts[at:to]
                starts = np.cumsum([0, *map(len, some[:-1])])
                whole = "".join(some)
                by_text: dict[int, list[tuple[int, int, int]]] = {}
                for a, b in m.stretches(whole, starts[[len(t) > 0 for t in some]]):
                    i = int(np.searchsorted(starts, a, "right")) - 1
                    o = int(starts[i])
                    by_text.setdefault(i, []).extend(m._runs(m.label(whole[a:b], whole[a - 1] if a > o else ""), a - o))
                for i, spans in by_text.items():
                    if spans:
                        names = sorted({m.names[s] for _, _, s in spans})
                        found.append((ids[at + i], names, sum(b - a for a, b, _ in spans), m.restored(some[i], spans)))
            yield pd.DataFrame(found, columns=["doc_id", "encodings", "n_garbled", "restored"])

    rows = documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text")
    return rows.mapInPandas(run, f"doc_id {kind}, encodings array<string>, n_garbled bigint, restored string")
