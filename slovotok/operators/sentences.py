"""Sentences, safe zones and clause boundaries: rules that depend on where the sentence before ended, so they are folds over
one document, run in Arrow batches. No shuffle; a document stays whole, whatever its length.

Defined results: null and white-space texts have no sentences; repeated documents give their own rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slovotok.plans.rules import Rule

# Pairs of brackets and quotes, abbreviations, markers of clauses and words that may stand before them.
BRACKETS = {"(": ")", "[": "]", "{": "}"}
QUOTES = {"«": "»", "„": "“", "“": "”", '"': '"'}
ABBREVIATIONS = frozenset("г ул д кв стр рис см им тов проф доц акад др пр т н э руб коп тыс млн млрд зам нач ред".split())
DOTTED = tuple(a + s + b for a, b in (("т.", "е."), ("т.", "к."), ("т.", "п."), ("т.", "д.")) for s in ("", " "))
MARKERS = ("что", "чтобы", "если", "когда", "пока", "поскольку", "хотя", "который", "которая", "которое", "которые", "потому что", "так как", "для того чтобы")
STRONG = frozenset(("потому что", "так как", "для того чтобы", "что", "чтобы", "если", "поскольку", "хотя"))
INTRODUCTORY = frozenset("безусловно вероятно возможно итак кстати конечно например однако следовательно значит".split())
COORDINATING = frozenset("и а но или либо да ну".split())
OPENING, CLOSING, SEPARATORS, TERMINALS = "([{«“„", ")]}»”“", ",;:—-", ".!?…\n"

_TERMINAL = regex.compile(r"[.!?…\n]+")
_NOT_NORMAL = regex.compile(r"[^\p{Alphabetic}-]")
_CLOSERS = regex.compile(r"[)\]}»”“]*")
_SPACE = regex.compile(r"\p{White_Space}*")
_TOKEN = regex.compile(r"(?P<space>\p{White_Space}+)|(?P<number>[0-9０-９]+)|(?P<word>[\p{Alphabetic}\-‑–']+)|(?P<punctuation>[«»—–…“”„!-/:-@\[-`{-~]+)|(?P<other>[^\p{White_Space}0-9０-９\p{Alphabetic}\-‑–'«»—…“”„!-/:-@\[-`{-~]+)")
#: Runs of punctuation, which may hold joiners, and words; only words are captured.
WORD = regex.compile(r"[«»—…“”„!-&(-,./:-@\[-`{-~][«»—–…“”„!-/:-@\[-`{-~]*+|([\p{Alphabetic}\-‑–']++)")
_MARKS = frozenset("«»—–…“”„!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‑")
_DELIMITER = {kind: regex.compile("[" + "".join("\\" + c for c in {*pairs, *pairs.values()}) + "]") for kind, pairs in (("parenthetical", BRACKETS), ("direct_speech", QUOTES))}


def zones(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of closed brackets and quotes, by start. Only the opener on top of the stack can be closed."""
    out = []
    for kind, pairs in (("parenthetical", BRACKETS), ("direct_speech", QUOTES)):
        closers = set(pairs.values())
        stack: list[tuple[str, int]] = []
        for m in _DELIMITER[kind].finditer(text):
            c = m.group()
            if c in closers and stack and pairs[stack[-1][0]] == c:
                out.append((stack.pop()[1], m.end(), kind))
            elif c in pairs:
                stack.append((c, m.start()))
    return sorted(out)


def _continues(text: str, at: int) -> bool:
    nxt = text[_SPACE.match(text, at).end() :][:1]
    return nxt in "—-,;:" and nxt != "" or nxt.islower()


def _abbreviated(text: str, start: int, at: int) -> bool:
    """Whether the full stop at `at` ends an abbreviation or stands in a number."""
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if before.isascii() and before.isdigit() and after.isascii() and after.isdigit():
        return True
    if text[max(start, at - 6) : at + 1].lower().endswith(DOTTED):
        return True
    word = regex.search(r"[\p{Alphabetic}]*$", text[max(0, at - 40) : at]).group()
    if not word:
        return False
    if word.lower() in ABBREVIATIONS:
        return True
    return len(word) == 1 and word.isupper() and text[_SPACE.match(text, at + 1).end() :][:1].isupper()


def sentence_spans(text: str, around: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    around = zones(text) if around is None else around
    start = _SPACE.match(text).end()
    cursor, out, z = start, [], 0
    while cursor < len(text):
        m = _TERMINAL.search(text, cursor)
        if not m:
            break
        at, to = m.span()
        cursor = to
        if text[at] == "." and to == at + 1 and _abbreviated(text, start, at):
            continue
        end = _CLOSERS.match(text, to).end()
        while z < len(around) and around[z][1] <= at:
            z += 1
        if z < len(around) and around[z][0] < at:
            _, zone_end, kind = around[z]
            if end < zone_end:
                continue
            if not (kind == "parenthetical" and not _continues(text, zone_end)) and _continues(text, end):
                continue
        out.append((start, end))
        start = cursor = _SPACE.match(text, end).end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def first_word(text: str, at: int) -> tuple[int, str] | None:
    """(start, word) of the first word of a text that begins at a place or after it. Only from the marks before the place on is it cut."""
    begin = at
    while begin and text[begin - 1] in _MARKS:
        begin -= 1
    return next(((m.start(), m.group()) for m in WORD.finditer(text, begin) if m.lastindex and m.start() >= at), None)


def clause_boundaries(text: str, markers: tuple[str, ...] = MARKERS, around: list[tuple[int, int, str]] | None = None, spans: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str, str, str]]:
    """(start, end of the first word, marker, kind, confidence) of every clause marker; zones and sentences may be given."""
    around, tokens = zones(text) if around is None else around, [(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]
    single = {m for m in markers if " " not in m}
    many = sorted((tuple(m.split()) for m in markers if " " in m), key=len, reverse=True)
    sentences = sentence_spans(text, around) if spans is None else spans
    lower = [t.lower() if k == "word" else "" for k, t, _ in tokens]
    words = [i for i, (k, _, _) in enumerate(tokens) if k == "word"]
    out, s = [], 0
    heads = single | {p[0] for p in many}
    inner = {w for p in many for w in p[1:]}
    previous = {i: words[n - 1] if n else -1 for n, i in enumerate(words) if lower[i] in heads or lower[i] in inner}
    for i in words:
        if lower[i] not in heads:
            continue
        whole = next((p for p in many if tuple(lower[i : i + len(p)]) == p), None)
        if whole is None:
            inside = any(p[k] == lower[i] and tuple(lower[i - k : i]) == p[:k] for p in many for k in range(1, len(p)) if i >= k)
            if inside or lower[i] not in single:
                continue
        marker = " ".join(whole) if whole else lower[i]
        confidence = "strong" if marker in STRONG else "weak"
        at = tokens[i][2]
        while s + 1 < len(sentences) and sentences[s + 1][0] <= at:
            s += 1
        kind = _boundary(tokens, i, at, around, sentences[s][0], lower[previous[i]] if previous[i] >= 0 else "", confidence)
        out.append((at, at + len(tokens[i][1]), marker, kind, confidence))
    return out


def _boundary(tokens: list[tuple[str, str, int]], i: int, at: int, around: list[tuple[int, int, str]], sentence: int, before: str, confidence: str) -> str:
    if any(a < at < b for a, b, _ in around):
        return "suppressed_safe_zone"
    j = i - 1
    while j >= 0 and tokens[j][2] >= sentence and tokens[j][1][-1] in OPENING:
        j -= 1
    if j < 0 or tokens[j][2] < sentence:
        return "sentence_start"
    last = tokens[i - 1][1][-1]
    j = i - 1
    while j >= 0 and tokens[j][1][-1] in CLOSING:
        j -= 1
    if j >= 0 and tokens[j][1][-1] == "," or last in SEPARATORS or last in TERMINALS:
        return "punctuated"
    if before in COORDINATING:
        return "ambiguous"
    return "before_marker" if confidence == "strong" else "ambiguous"


def introductory_gaps(text: str, phrases: tuple[str, ...], around: list[tuple[int, int, str]] | None = None, spans: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, replacement) where a comma is missing after an introductory phrase at the start of a sentence: the gap to the
    next word after a single word, the next character after other phrases. Zones and sentences may be given."""
    around, out = zones(text) if around is None else around, set()
    single = {p for p in phrases if regex.fullmatch(r"\p{Alphabetic}+", p)}
    longest = max(map(len, phrases), default=0)
    for start, _ in sentence_spans(text, around) if spans is None else spans:
        if any(a < start < b for a, b, _ in around):
            continue
        word = _TOKEN.match(text, start)
        if word and word.lastgroup == "word" and word.group().lower() in single & INTRODUCTORY:
            gap = _SPACE.match(text, word.end())
            nxt = _TOKEN.match(text, gap.end())
            if gap.group() and nxt and nxt.lastgroup == "word":
                out.add((word.end(), gap.end(), ", "))
        tail = text[start : start + longest].lower()
        for p in phrases:
            at = start + len(p)
            if p not in single and tail.startswith(p) and not text[at : at + 1].isalpha():
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] not in ("", ","):
                    out.add((at, at + 1, ", " + text[at]))
    return sorted(out)


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s, e): the sentences of each document, offsets in characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, a, b) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for n, (a, b) in enumerate(sentence_spans(t), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "s", "e"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n int, s int, e int")


def cross_sentence_terms(docs: DataFrame, least: int = 4, stop: Iterable[str] = ()) -> DataFrame:
    """(doc_id, term, n_sentences): words of `least` letters at least that occur in more than one sentence of a document. Words and
    sentences are walked once, side by side, so nothing is joined or shuffled."""
    skipped = frozenset(stop)

    def terms(text: str) -> dict[str, int]:
        spans, n = sentence_spans(text), 0
        seen: dict[str, int] = {}
        last: dict[str, int] = {}
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "word":
                continue
            while n < len(spans) and spans[n][0] <= m.start():
                n += 1
            term = _NOT_NORMAL.sub("", m.group()).lower()
            if len(term) >= least and term not in skipped and last.get(term) != n:
                seen[term], last[term] = seen.get(term, 0) + 1, n
        return seen

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, w, n) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for w, n in terms(t).items() if n > 1]
            yield pd.DataFrame(rows, columns=["doc_id", "term", "n_sentences"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text <> ''").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, term string, n_sentences bigint")


def boundaries(docs: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(doc_id, s, e, marker, kind, confidence) of every clause marker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for x in clause_boundaries(t, markers)]
            yield pd.DataFrame(rows, columns=["doc_id", "s", "e", "marker", "kind", "confidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = "|".join(sorted({m.split()[0] for m in markers}))
    held = docs.filter(F.lower("text").rlike(heads)).select("doc_id", "text")
    return held.mapInPandas(run, f"doc_id {kind}, s int, e int, marker string, kind string, confidence string")


def fold_issues(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, text, rule_id, s, e, replacement) of the rules that need sentences or clauses."""
    todo = [(r.rule_id, r.kind, tuple(m.lower() for m in r.params.get("phrases") or r.params.get("markers") or MARKERS)) for r in rules]

    heads = {markers: tuple({m.split()[0] for m in markers}) for _, kind, markers in todo if kind == "missing_comma_before_subordinator"}

    def issues(text: str) -> list[tuple[str, int, int, str]]:
        # Zones and sentences are found once for all rules.
        around, out = zones(text), []
        spans, lower = sentence_spans(text, around), text.lower()
        for rule_id, kind, markers in todo:
            if kind == "sentence_initial_lowercase":
                for a, _ in spans:
                    word = first_word(text, a)
                    if not word:
                        break
                    if word[1][0].islower():
                        out.append((rule_id, word[0], word[0] + 1, word[1][0].upper()))
            elif kind == "introductory_phrase_comma":
                out += [(rule_id, *x) for x in introductory_gaps(text, markers, around, spans)]
            elif any(h in lower for h in heads[markers]):
                out += [(rule_id, s, e, ", " + text[s:e]) for s, e, _, k, _ in clause_boundaries(text, markers, around, spans) if k == "before_marker"]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, t in enumerate(batch.column("text").to_pylist()) for x in issues(t)]
            at = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()), 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text").take(at), *made], names=["doc_id", "text", "rule_id", "s", "e", "replacement"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, rule_id string, s int, e int, replacement string")
