"""Ordinary text that a sample of Russian documents lacks, made from rules: other languages, drawn tables, signs, typing habits.

Nothing here is a phrase. Words of a language are strings of letters of its alphabet in which vowels and consonants mostly
alternate, as in any language; drawn tables follow the sets of line pieces that Unicode defines; signs are those of the Unicode
categories for signs, alone, repeated, and next to numbers and words. The generator is seeded, so results are the same each time.
"""

from __future__ import annotations

import random
import re
import unicodedata
from functools import lru_cache

import numpy as np

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
# The small letters that the alphabets of languages add to the basic ones.
LATIN_EXTRAS = {
    "English": "", "German": "äöüß", "French": "àâæçéèêëîïôœùûüÿ", "Spanish": "áéíñóúü", "Portuguese": "àáâãçéêíóôõú", "Italian": "àèéìíîòóùú", "Catalan": "àçéèíïóòúü·",
    "Dutch": "áéëèíïóöúü", "Swedish": "åäöé", "Danish": "æøåé", "Icelandic": "áðéíóúýþæö", "Polish": "ąćęłńóśźż", "Czech": "áčďéěíňóřšťúůýž", "Slovak": "áäčďéíĺľňóôŕšťúýž",
    "Hungarian": "áéíóöőúüű", "Romanian": "ăâîșțşţ", "Croatian": "čćđšž", "Turkish": "çğıöşüâîû", "Azerbaijani": "çəğıöşü", "Lithuanian": "ąčęėįšųūž", "Latvian": "āčēģīķļņšūž",
    "Estonian": "äõöüšž", "Albanian": "çë", "Esperanto": "ĉĝĥĵŝŭ", "Welsh": "âêîôûŵŷ", "Irish": "áéíóú",
}
ALPHABETS = {name: _LATIN + extra for name, extra in LATIN_EXTRAS.items()} | {
    "Russian": _RUSSIAN, "Ukrainian": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "Belarusian": "абвгдеёжзійклмнопрстуўфхцчшыьэюя", "Bulgarian": "абвгдежзийклмнопрстуфхцчшщъьюя",
    "Serbian": "абвгдђежзијклљмнњопрстћуфхцчџш", "Macedonian": "абвгдѓежзѕијклљмнњопрстќуфхцчџш", "Kazakh": _RUSSIAN + "әғқңөұүһі", "Tatar": _RUSSIAN + "әҗңөүһ",
    "Old Russian": _RUSSIAN + "ѣіѳѵ", "Greek": "αβγδεζηθικλμνξοπρστυφχψως" + "άέήίόύώϊϋ",
}
_VOWELS = "aeiouyаеёиоуыэюяєіїӣәөұүѣѵαεηιουωæœøəı"
#: Characters of a language's text.
LENGTH = 16_000
_QUOTES = ("«»", "“”", "„“", "‘’", "‚‘", "‹›", '""', "”“")
_STRESS = "\u0301"


def _is_vowel(c: str) -> bool:
    return unicodedata.normalize("NFD", c)[0] in _VOWELS


def language_text(alphabet: str, length: int, seed: int) -> str:
    """Sentences of made-up words; letters with a mark are rarer than the others, and seldom stand next to each other."""
    rng = random.Random(seed)
    kinds: dict[bool, tuple[list[str], list[float]]] = {}
    for vowel in (True, False):
        letters = [c for c in alphabet if _is_vowel(c) == vowel]
        kinds[vowel] = letters, [0.4 if len(unicodedata.normalize("NFD", c)) > 1 and c not in "йї" else 1.0 for c in letters]
    words, held, fresh = [], 0, True
    while held < length:
        vowel, word = rng.random() < 0.45, []
        for _ in range(rng.choice((1, 2, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9, 11))):
            word.append(rng.choices(*kinds[vowel])[0])
            vowel = vowel == (rng.random() < 0.25)
        w = "".join(word)
        w = w.capitalize() if fresh or rng.random() < 0.12 else w.upper() if rng.random() < 0.15 else w
        if rng.random() < 0.05:
            w = f"{rng.choices(*kinds[rng.random() < 0.5])[0]}{rng.choice('’-' + chr(39))}{w}"
        if rng.random() < 0.05:
            a, b = rng.choice(_QUOTES)
            w = f"{a}{w}{b}"
        end = rng.choices(("", ",", ".", ";", ":", "!", "?", " –", " —", "…"), (80, 8, 8, 1, 1, 1, 1, 1, 1, 1))[0]
        fresh = end in (".", "!", "?", "…")
        words.append(w + end + ("\n" if fresh and rng.random() < 0.2 else " "))
        held += len(words[-1])
    return "".join(words)


def drawn_tables(seed: int) -> str:
    """Tables, frames and bars of line and block characters, with numbers and short words in them."""
    rng = random.Random(seed)
    find = lambda style, part: unicodedata.lookup(f"BOX DRAWINGS {style} {part}")
    out = []
    for style in ("LIGHT", "HEAVY", "DOUBLE"):
        line, bar = find(style, "HORIZONTAL"), find(style, "VERTICAL")
        ends = [find(style, f"{y} AND {x}") for y in ("DOWN", "VERTICAL", "UP") for x in ("RIGHT", "HORIZONTAL", "LEFT")]
        for _ in range(6):
            widths = [rng.randint(3, 12) for _ in range(rng.randint(1, 4))]
            rule = lambda k, widths=widths, ends=ends, line=line: ends[3 * k] + ends[3 * k + 1].join(line * w for w in widths) + ends[3 * k + 2]
            rows = []
            for _ in range(rng.randint(1, 3)):
                word = lambda: "".join(rng.choice(_RUSSIAN) for _ in range(rng.randint(1, 3)))
                cells = [rng.choice((str(rng.randint(0, 999)), word(), "", "-")) for _ in widths]
                rows.append(bar + bar.join(f" {c}".ljust(w) for c, w in zip(cells, widths, strict=True)) + bar)
            out += [rule(0), f"\n{rule(1)}\n".join(rows), rule(2), line * 12, ""]
    blocks = [chr(c) for c in range(0x2580, 0x25A0)]
    out += ["".join(rng.choice(blocks) * rng.randint(1, 4) for _ in range(6)) for _ in range(60)]
    return "\n".join(out)


def signs(seed: int) -> str:
    """Signs (currency, mathematics, other) alone, repeated, and next to numbers and words; runs of marks."""
    rng = random.Random(seed)
    ranges = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), *range(0xA1, 0xC0), 0xD7, 0xF7, *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0),
              *range(0x2116, 0x2127), *range(0x2190, 0x21D5), *range(0x2200, 0x2266), *range(0x25A0, 0x25D0)]
    known = [chr(c) for c in ranges if unicodedata.category(chr(c))[0] in "PSNL"]
    out = []
    for c in known:
        n = str(rng.randint(1, 99))
        word = "".join(rng.choice(_RUSSIAN) for _ in range(3))
        out += [f"{c} {word} {c}{n} {n}{c} {n} {c} {n} {word}{c} {c}{word}, {c}. ({c})", c * rng.randint(2, 12) + "\n"]
    for _ in range(400):
        some = [rng.choice(known[:32] if rng.random() < 0.5 else known) for _ in range(rng.randint(1, 3))]
        out.append("".join(c * rng.choice((1, 1, 2, 3, 8)) for c in some))
    return " ".join(out)


#: After so many places, what is typed for a character is the same again.
STRESSED_PERIOD, ALIKE_PERIOD = 5 * len(_QUOTES), 210


def stressed(c: str, place: int) -> str:
    """A character at a place with a stress mark, or as a quotation mark of another kind."""
    if c in ("«", "»"):
        return _QUOTES[place // 5 % len(_QUOTES)][c == "»"]
    return c + _STRESS if place % 5 == 0 and c.lower() in "аеиоуыэюя" else c


_SWAPS = {" ": " \xa0\u202f\u2009\u3000\u2002\u2007", "а": "аαa", "е": "еe", "о": "оοo", "с": "сc", "р": "рρp", "х": "хx", "у": "уy", "к": "кk", "А": "АΑA", "В": "ВΒB", "Е": "ЕΕE", "К": "КΚK", "М": "МΜM", "Н": "НΗH", "О": "ОΟO", "Р": "РΡP", "С": "СC", "Т": "ТΤT", "Х": "ХΧX",
          ",": ",\uff0c", ".": ".\uff0e", "!": "!\uff01", "?": "?\uff1f", "-": "-\u2011\uff0d", "й": ("й", "и\u0306"), "ё": ("ё", "е\u0308", "ë")}
#: Invisible characters, and how often there is one.
INVISIBLE, INVISIBLE_EVERY = "\xad\u200b\u200c\u200d\u2060\ufeff\u200e", 23


def look_alike(c: str, place: int, every: int) -> str:
    """A character at a place as one of another alphabet, or as another space, hyphen or mark, that looks the same (one of `every`)."""
    other = _SWAPS.get(c)
    if not other or place % every:
        return c
    return other[-1 if every == 1 and c.isalpha() else (place * 7 // 5) % len(other)]


def look_alikes(text: str, every: int = 3) -> str:
    """The text with such characters, and invisible ones."""
    out = []
    for i, c in enumerate(text):
        out.append(look_alike(c, i, every))
        if i % INVISIBLE_EVERY == INVISIBLE_EVERY - 1:
            out.append(INVISIBLE[(i // INVISIBLE_EVERY) % len(INVISIBLE)])
    return "".join(out)


#: What a typed sign costs at most (nats): after a space, digit, mark or sign; before one; after itself; a mark after a mark, and after itself.
SIGN_AFTER, SIGN_BEFORE, SIGN_AGAIN, MARK_MARK, MARK_AGAIN = -6.5, -2.5, -1.0, -2.5, -0.3
#: A letter that only some alphabets have: after a letter of such an alphabet or at the start of a word; and what follows it.
LETTER_AFTER, LETTER_BEFORE = -6.5, -4.5
#: What the script of a word changes for at least: between letters that look like none of the other, or from a small letter to a capital.
CROSSING = -12.0
#: Line pieces whose arms meet, and one that goes on.
ARMS_MEET, ARM_AGAIN = -2.0, -0.4


# Letters that look like one of another alphabet.
ALIKE = "abcehijkmopsxyABCEHIJKMOPSTXYZавекмнорстухѕіјһАВЕЗІКМНОРСТУХЅЈабαβεηικμνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"


def typed_ceiling(letters: str) -> np.ndarray:
    """The most that the log probability of pairs of the characters in typed text can be, inf where there is no such bound."""
    script = np.array([unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else "" for c in letters])
    is_letter = np.isin(script, ["LATIN", "CYRILLIC", "GREEK"])
    other = (script[:, None] != script[None, :]) & is_letter[:, None] & is_letter[None, :]
    alike = np.array([c in ALIKE for c in letters])
    small, large = np.array([c.islower() for c in letters]), np.array([c.isupper() for c in letters])
    bad = other & (~(alike[:, None] | alike[None, :]) | (small[:, None] & large[None, :]))
    return np.where(bad, CROSSING, np.inf)


def arms(c: str) -> tuple[str, str]:
    """The kinds of line with which a line piece goes on to the left and to the right; empty where it does not."""
    name = unicodedata.name(c, "")
    if not name.startswith("BOX DRAWINGS"):
        return "", ""
    all_of = "DOUBLE" if name.startswith("BOX DRAWINGS DOUBLE") else "HEAVY" if name.startswith("BOX DRAWINGS HEAVY") else "SINGLE"
    kinds = {d: k or all_of for d, k in re.findall(r"(HORIZONTAL|LEFT|RIGHT)(?: (SINGLE|DOUBLE))?", name)}
    return kinds.get("LEFT", kinds.get("HORIZONTAL", "")), kinds.get("RIGHT", kinds.get("HORIZONTAL", ""))


def typed_floor(letters: str) -> np.ndarray:
    """The least log probability of pairs of the characters in text typed as such, -inf where there is no such bound. Signs stand
    next to spaces, digits, marks and signs; marks are repeated and mixed; drawn lines go on; letters stand next to letters of the
    same alphabet, with a capital only at the start of a word or among capitals."""
    n = len(letters)
    kind = np.array(["S" if ord(c) > 126 and unicodedata.category(c)[0] in "PSN" else "A" if ord(c) < 127 and unicodedata.category(c)[0] in "PS" else "L" if c.isalpha() else "W" for c in letters])
    sign, mark, letter = kind == "S", kind == "A", kind == "L"
    out = np.full((n, n), -np.inf)
    out[np.ix_(~letter, sign)] = SIGN_AFTER
    opening = np.array([unicodedata.category(c) in ("Pi", "Ps") for c in letters])
    out[np.ix_(sign & ~opening, ~letter & ~sign)] = SIGN_BEFORE
    out[np.ix_(mark, mark)] = MARK_MARK
    same = np.arange(n)
    out[same[sign], same[sign]] = SIGN_AGAIN
    out[same[mark], same[mark]] = MARK_AGAIN
    basic = set(_LATIN + _RUSSIAN)
    at = {c: i for i, c in enumerate(letters)}
    for alphabet in ALPHABETS.values():
        small, large = [[at[x] for c in alphabet if len(x := f(c)) == 1 and x in at] for f in (str, str.upper)]
        own_small, own_large = [[at[x] for c in alphabet if c not in basic and len(x := f(c)) == 1 and x in at] for f in (str, str.upper)]
        for of, own, others in ((small, own_small, small + large), (large, own_large, large)):
            out[np.ix_(others, own)] = np.maximum(out[np.ix_(others, own)], LETTER_AFTER)
            out[np.ix_(~letter, own)] = LETTER_AFTER
            out[np.ix_(own, ~letter & ~sign)] = np.maximum(out[np.ix_(own, ~letter & ~sign)], LETTER_BEFORE)
            out[np.ix_(own, small + of)] = np.maximum(out[np.ix_(own, small + of)], LETTER_BEFORE)
    left, right = np.array([arms(c) for c in letters]).T
    out[(right[:, None] == left[None, :]) & (right[:, None] != "")] = ARMS_MEET
    goes_on = (left == right) & (left != "")
    out[same[goes_on], same[goes_on]] = ARM_AGAIN
    return out


@lru_cache(maxsize=1)
def languages() -> tuple[tuple[str, str], ...]:
    """(language, text) for every alphabet."""
    return tuple((name, language_text(letters, LENGTH, k)) for k, (name, letters) in enumerate(ALPHABETS.items()))


@lru_cache(maxsize=1)
def drawings() -> tuple[str, ...]:
    """Drawn tables, signs, and addresses and code, whose ASCII marks stand anywhere."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(_LATIN) for _ in range(rng.randint(1, 8)))
    code = "".join(word() + rng.choice("://.?=&#@_-()[]{}<>\\|;,'\"+*%$!~^` ") * rng.choice((1, 1, 1, 2)) for _ in range(2000))
    return drawn_tables(1), signs(2), code
