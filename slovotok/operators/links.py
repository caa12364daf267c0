"""What stands between neighbouring words: islands that part them, clause markers, and slots for marks.

One fold a document: its words, sentences, zones, islands and clause boundaries are walked side by side, so nothing is joined.
Two words may be linked if they lie in one island; a slot is the gap between two neighbouring words with the marks it has, the ones
that are expected or forbidden there, and how strong its boundary is.

Defined results: null and empty texts, and texts of one word, give no slot; the marks of a slot are distinct and sorted.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slovotok.operators import coordination, sentences
from slovotok.operators.inspection import document_islands

# The marks that count, and the words after which a comma is expected besides the introductory ones.
MARKS = {",": "comma", "—": "dash", "-": "dash", "–": "dash", ":": "colon", ";": "semicolon", ".": "period"}
ALSO_INTRODUCTORY = frozenset(("по-видимому", "во-первых", "во-вторых"))
_BLOCKED = ("colon", "comma", "dash")
_ACTIONABLE = ("before_marker", "punctuated")


def document_slots(text: str) -> list[tuple[int, int, str, str, str, list[str], list[str], list[str], str, list[str]]]:
    """(start, end, left, right, island, marks, expected, forbidden, strength, blockers) of the gap between neighbouring words."""
    around = sentences.zones(text)
    spans = sentences.sentence_spans(text, around)
    islands = document_islands(text, around, spans)
    starts = [x for _, x, _, _ in islands]
    clauses = {s for s, _, _, kind, _ in sentences.clause_boundaries(text) if kind in _ACTIONABLE}
    grouped = coordination.member_gaps(text)
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in sentences._TOKEN.finditer(text)]
    words = [i for i, t in enumerate(tokens) if t[0] == "word"]

    def island(at: int) -> int:
        """The first island that holds a place: zones hold what lies in them, so the last one that begins before it, if it reaches."""
        k = bisect_right(starts, at) - 1
        return k if k >= 0 and islands[k][2] > at else -1

    out = []
    for i, j in zip(words, words[1:]):
        _, left, _, a = tokens[i]
        _, right, b, _ = tokens[j]
        here, there = island(tokens[i][2]), island(b)
        kinds = {islands[k][3] for k in (here, there) if k >= 0}
        blockers = set()
        if here < 0 or here != there:
            blockers.add("unsafe_boundary")
        if "direct_speech" in kinds:
            blockers.add("direct_speech_boundary")
        if "parenthetical" in kinds:
            blockers.add("parenthesis_boundary")
        marks = sorted({MARKS[t[1]] for t in tokens[i + 1 : j] if t[1] in MARKS and t[0] != "word"} | {MARKS[t[1]] for t in tokens[i + 1 : j] if t[0] == "punctuation" and t[1] in MARKS})
        introductory = left.lower() in sentences.INTRODUCTORY or left.lower() in ALSO_INTRODUCTORY
        clause, member = b in clauses and not blockers, (a, b) in grouped
        expected = sorted({"comma"} if clause or introductory or member else set()) + (["dash"] if left[:1].isupper() and right[:1].isupper() else [])
        forbidden = sorted({*(_BLOCKED if blockers else ()), *(("colon",) if member and "comma" in marks else ())})
        strength = "unsafe" if blockers else "strong" if clause or introductory or member else "weak"
        out.append((a, b, left, right, islands[here][3] if here >= 0 else "", marks, expected, forbidden, strength, sorted(blockers)))
    return out


def punctuation_slots(docs: DataFrame) -> DataFrame:
    """(doc_id, s, e, left_word, right_word, island, marks, expected, forbidden, strength, blockers) of all neighbouring words."""
    names = ["doc_id", "s", "e", "left_word", "right_word", "island", "marks", "expected", "forbidden", "strength", "blockers"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, *x) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for x in document_slots(t)], columns=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text <> ''").select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, s int, e int, left_word string, right_word string, island string, marks array<string>, expected array<string>, forbidden array<string>, strength string, blockers array<string>"
    )


def missing_marks(slots: DataFrame, mark: str = "comma") -> DataFrame:
    """The slots where a mark is expected, allowed, absent and nothing stands against it."""
    has = lambda c: F.array_contains(c, mark)
    return slots.filter(has("expected") & ~has("forbidden") & ~has("marks") & (F.size("blockers") == 0))
