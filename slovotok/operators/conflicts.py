"""Conflicts of agreement and government as a fold over one text: its words are cut, their readings disambiguated and the chains of
words looked at in one go, so that neither words nor profiles travel or are sorted.

What a word can be depends on its tags only, of which there are few: a State is made once for each set of tags that is left, and what
two states do to each other is kept. disambiguation.prune() is the same rules with evidence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex

from slovotok.functions.morphology import preposition_cases
from slovotok.operators import sentences
from slovotok.operators.disambiguation import PASSES, ROWS, TAGS, _agree, _complete, _fit, _modifier, _predicate, _subject, documents_of
from slovotok.operators.inspection import document_islands

#: Words after the first of a chain.
REACH = 5
#: Fields of a reading: those of TAGS, its class as a numeral, the place of its lemma among the word's sorted ones, and what a verb of that lemma governs.
FIELDS = (*TAGS, "num_class", "lemma_at", "governs")
#: What stands between fields, readings, and in what a verb governs between its parts.
FIELD, READING, PART, ITEM = "\x1f", "\x1e", "\x1d", "\x1c"
#: States and pairs that are kept; when there are more, they are made again.
KEPT = 1 << 17
MODIFIERS, HEADS, NOMINAL, PREDICATES = ("adjective", "participle"), ("noun", "pronoun", "numeral"), ("noun", "pronoun", "adjective", "numeral", "participle"), ("verb", "participle", "predicative")
#: Columns of a conflict after doc_id.
CONFLICT = "kind string, s int, e int, ws int, we int, word string, lemma_at int, cases array<string>, numbers array<string>, genders array<string>"

_ONE_LINE = regex.compile(r"[\p{White_Space}--\n]+", regex.V1)


def _values(readings: list[dict], field: str) -> list[str]:
    return sorted({r[field] for r in readings if r[field]})


class State:
    """A word's readings that are left, what they all can be, and their sets of features."""

    def __init__(self, tags: str, preposition: str, readings: list[dict]):
        every = lambda test: bool(readings) and all(map(test, readings))
        self.tags, self.preposition, self.readings = tags, preposition, readings
        # What disambiguation asks.
        self.prepositional = every(lambda r: r["pos"] == "preposition")
        self.sure_modifier, self.sure_noun = every(lambda r: _modifier(r) and _complete(r)), every(lambda r: r["pos"] == "noun" and _complete(r))
        self.sure_subject, self.sure_predicate = every(_subject), every(_predicate)
        # Roles.
        self.modifier, self.noun = every(_modifier), every(lambda r: r["pos"] == "noun")
        self.head, self.nominal = every(lambda r: r["pos"] in HEADS), every(lambda r: r["pos"] in NOMINAL)
        self.plain_modifier, self.may_modify = every(lambda r: r["pos"] in MODIFIERS), every(lambda r: r["pos"] in (*MODIFIERS, "numeral"))
        self.numeral, self.some_noun = every(lambda r: r["pos"] == "numeral"), any(r["pos"] == "noun" for r in readings)
        self.subject, self.predicate = every(lambda r: r["pos"] in HEADS and r["case"] in (None, "nominative")), every(lambda r: r["pos"] in PREDICATES)
        self.clause_predicate = any(r["pos"] == "verb" and r["verb_form"] != "infinitive" or r["pos"] == "predicative" or r["pos"] == "adjective" and r["adjective_form"] == "short" for r in readings)
        self.clause_subject = any(r["pos"] in ("noun", "pronoun") and r["case"] in (None, "nominative") for r in readings)
        # Sets.
        past = [r for r in readings if r["tense"] == "past" and r["number"] in (None, "singular")]
        self.cases, self.numbers, self.genders, self.own_persons = (_values(readings, f) for f in ("case", "number", "gender", "person"))
        self.past_singular, self.past_genders = bool(past), _values(past, "gender")
        self.persons = {p for p in ("third" if r["pos"] == "noun" else r["person"] for r in readings) if p}
        self.caseless = any(not r["case"] for r in readings)
        self.paucal = any(r["num_class"] == "paucal" for r in readings)
        lemmas = {r["lemma_at"]: r["governs"] for r in readings if r["lemma_at"]}
        self.lemma_at = int(min(lemmas)) if len(lemmas) == 1 else None
        # What it governs: a preposition by itself, a verb of one lemma by the table of verbs.
        self.governs = preposition_cases().get(preposition)
        self.direct, self.through = None, {}
        frame = next(iter(lemmas.values())) if len(lemmas) == 1 and every(lambda r: r["pos"] == "verb") else None
        if frame:
            direct, through = frame.split(PART)
            self.direct = [c for c in direct.split(ITEM) if c]
            for pair in through.split(ITEM):
                if pair:
                    self.through.setdefault(pair.rpartition(" ")[0], []).append(pair.rpartition(" ")[2])
        self.begins = bool(self.modifier or self.subject or self.numeral or self.may_modify or self.governs or self.direct or self.through)


_STATES: dict[tuple, State] = {}
_MET: dict[tuple, object] = {}


def _state(tags: str, preposition: str, readings: list[dict]) -> State:
    key = (tags, preposition, *(r["at"] for r in readings))
    found = _STATES.get(key)
    if found is None:
        if len(_STATES) >= KEPT:
            _STATES.clear()
        found = _STATES[key] = State(tags, preposition, readings)
    return found


def state(tags: str | None, word: str) -> State:
    """The state of a word with all its readings; no tags for an unknown one."""
    lower = word.lower()
    preposition = lower if lower in preposition_cases() else ""
    found = _STATES.get((tags or "", preposition))
    if found is None:
        readings = [dict(zip(FIELDS, (v or None for v in r.split(FIELD)), strict=True)) | {"at": i} for i, r in enumerate(tags.split(READING))] if tags else []
        found = _state(tags or "", preposition, readings)
        _STATES[(tags or "", preposition)] = found
    return found


def _left(x: State, test) -> State:
    """x without the readings for which the test holds, unless it would lose all."""
    kept = [r for r in x.readings if not test(r)]
    return _state(x.tags, x.preposition, kept) if 0 < len(kept) < len(x.readings) else x


def _governed(a: State, b: State) -> tuple[State, State]:
    b = _left(b, lambda r: r["pos"] in ("verb", "gerund"))
    return a, _left(b, lambda r: bool(r["case"]) and r["case"] not in a.governs) if a.governs else b


def _agreeing(a: State, b: State) -> tuple[State, State]:
    if not any(_modifier(x) and y["pos"] == "noun" and _agree(x, y) for x in a.readings for y in b.readings):
        return a, b
    right = _left(b, lambda r: r["pos"] == "noun" and _complete(r) and not any(_agree(x, r) for x in a.readings)) if a.sure_modifier else b
    return _left(a, lambda r: _modifier(r) and _complete(r) and not any(_agree(r, y) for y in right.readings)) if b.sure_noun else a, right


def _fitting(a: State, b: State) -> tuple[State, State]:
    if not any(_fit(x, y) for x in a.readings for y in b.readings):
        return a, b
    right = _left(b, lambda r: not any(_fit(x, r) for x in a.readings)) if a.sure_subject else b
    return _left(a, lambda r: not any(_fit(r, y) for y in right.readings)) if b.sure_predicate else a, right


def _kept(what, a: State, b: State):
    """what(a, b), computed once a pair."""
    key = (what, a, b)
    found = _MET.get(key)
    if found is None:
        if len(_MET) >= KEPT:
            _MET.clear()
        found = _MET[key] = what(a, b)
    return found


def disambiguate(linked: list[bool], states: list[State]) -> None:
    """prune() on states, in place."""
    pairs = [i for i in range(len(states) - 1) if linked[i]]
    first = [i for i in pairs if not (i and linked[i - 1])]
    for _ in range(PASSES):
        changed = False
        for step, places in ((_governed, pairs), (_agreeing, pairs), (_fitting, first)):
            for i in places:
                a, b = states[i], states[i + 1]
                if a.prepositional if step is _governed else (a.sure_modifier or b.sure_noun) if step is _agreeing else (a.sure_subject or b.sure_predicate):
                    x, y = _kept(step, a, b)
                    if x is not a or y is not b:
                        states[i], states[i + 1], changed = x, y, True
        if not changed:
            break


def differ(a: Iterable[str] | None, b: Iterable[str] | None) -> bool:
    """Whether two sets of values both hold something and nothing in common."""
    return bool(a) and bool(b) and set(a).isdisjoint(b)


def genders_differ(a: list[str], b: list[str]) -> bool:
    return differ(a, b) and "common" not in a and "common" not in b


def _same(a: str | None, b: str | None) -> bool:
    return a is None or b is None or a == b


def modifier_conflict(m: State, n: State) -> bool:
    """Whether no reading of a modifier agrees with any of a noun."""

    def pair(a: dict, b: dict) -> bool:
        if not (_same(a["case"], b["case"]) and _same(a["number"], b["number"])):
            return False
        # Where a number is unknown it may be plural.
        return _same(a["gender"], b["gender"]) or "common" in (a["gender"], b["gender"]) or None in (a["number"], b["number"]) or "plural" in (a["number"], b["number"])

    if not (m.modifier and n.noun):
        return False
    singular = not m.numbers or not n.numbers or "singular" in m.numbers or "singular" in n.numbers
    if differ(m.cases, n.cases) or differ(m.numbers, n.numbers) or singular and genders_differ(m.genders, n.genders):
        return True
    known = m.cases and n.cases and m.numbers and n.numbers and (not singular or m.genders and n.genders)
    return bool(known) and not any(pair(a, b) for a in m.readings for b in n.readings)


def predicate_conflict(s: State, p: State) -> bool:
    """Whether a subject and the predicate after it differ in number, person or (past singular) gender."""
    if not (s.subject and p.predicate):
        return False
    gender = p.past_singular and genders_differ(s.genders, p.past_genders) and "plural" not in s.numbers
    return differ(s.numbers, p.numbers) or differ(s.persons, p.own_persons) or gender


def government_conflict(allowed: Iterable[str] | None, n: State) -> bool:
    """Whether every reading of a nominal has a case and none is allowed."""
    return n.nominal and not n.caseless and differ(allowed, n.cases)


def numeral_conflict(q: State, n: State) -> bool:
    """Whether a numeral in the nominative or accusative and a noun cannot stand together."""

    def pair(a: dict, b: dict) -> bool | None:
        if a["num_class"] in ("paucal", "many", "collective"):
            if a["case"] not in ("nominative", "accusative"):
                return None
            wanted = (("case", "genitive"), ("number", "singular" if a["num_class"] == "paucal" else "plural"))
            if any(b[f] is not None and b[f] != v for f, v in wanted):
                return False
            return None if any(b[f] is None for f, v in wanted) else True
        if a["num_class"] in ("one", "ordinal"):
            return _same(a["case"], b["case"]) and _same(a["number"], b["number"]) and ("plural" in (a["number"], b["number"]) or _same(a["gender"], b["gender"]))
        return None

    if not (q.numeral and n.head):
        return False
    pairs = [pair(a, b) for a in q.readings for b in n.readings if b["pos"] == "noun"]
    return bool(pairs) and all(x is False for x in pairs)


def missing_comma(a: State, b: State, c: State) -> bool:
    """Whether two modifiers of one case and number stand before a noun."""
    both = a.plain_modifier and b.plain_modifier and not set(a.cases).isdisjoint(b.cases) and not set(a.numbers).isdisjoint(b.numbers)
    return both and c.some_noun


_SHAPES = {1: "numeral_noun_agreement_basic", 2: "compound_numeral_nominal_group_agreement_basic", 3: "typed_compound_numeral_nominal_group_agreement_basic"}


def relations(p: list[State], before: State | None, second: str, commas: bool) -> Iterator[tuple]:
    """(kind, last, target, cases, numbers, genders) of each conflict that a chain shows, from its first word to the word `last`;
    `target` is the word that should have these features. `before` is the word before, whatever stands between, `second` the next word."""
    first, n_words = p[0], len(p)
    numeral_before = before is not None and before.numeral
    free = not numeral_before and not (before is not None and before.prepositional)

    def heads(a: int, b: int, from_: int) -> Iterator[int]:
        """Places of heads with nothing but modifiers since from_."""
        for n in range(a, min(b, n_words)):
            if p[n].head and all(p[i].may_modify for i in range(from_, n)):
                yield n

    if first.modifier and free and _kept(modifier_conflict, first, p[1]):
        yield "adj_noun_agreement_demo", 1, 0, p[1].cases, p[1].numbers, p[1].genders
    if first.subject and _kept(predicate_conflict, first, p[1]):
        yield "subject_predicate_agreement_basic", 1, 1, None, first.numbers, first.genders
    if first.modifier and free:
        for n in range(2, min(4, n_words)):
            if p[n].noun and all(x.modifier for x in p[:n]):
                for i in range(n):
                    if _kept(modifier_conflict, p[i], p[n]):
                        yield "nominal_group_modifier_agreement_basic", n, i, p[n].cases, p[n].numbers, p[n].genders
    if first.governs:
        for n in heads(1, 5, 1):
            if government_conflict(first.governs, p[n]):
                yield "preposition_government_basic" if n == 1 else "preposition_nominal_group_government_basic", n, n, first.governs, p[n].numbers, None
    if first.direct:
        for n in heads(1, 4, 1):
            if government_conflict(first.direct, p[n]):
                yield "verb_government_basic", n, n, first.direct, p[n].numbers, None
    if first.through and (allowed := first.through.get(second.lower())):
        for n in heads(2, 5, 2):
            if government_conflict(allowed, p[n]):
                yield "verb_government_basic", n, n, allowed, p[n].numbers, None
    for k in (1, 2, 3):
        if k >= n_words or not p[k - 1].numeral:
            break
        if k > 1 and numeral_before or p[k].numeral:
            continue
        for n in range(k, min(k + 3, n_words)):
            if all(x.modifier for x in p[k:n]) and _kept(numeral_conflict, p[k - 1], p[n]):
                kind = _SHAPES[k] if k > 1 or n == 1 else "numeral_nominal_group_agreement_basic"
                yield kind, n, n, ("genitive",), ("singular",) if p[k - 1].paucal else ("plural",), None
    if commas and n_words > 2 and missing_comma(first, p[1], p[2]):
        yield "coordination_comma_basic", 1, None, None, None, None


def cut(text: str) -> tuple[list[str], list[tuple[int, int]], list[bool]]:
    """The words of a text, their places, and whether a word follows each with nothing but space of one line between."""
    spans = [m.span() for m in sentences.WORD.finditer(text) if m.lastindex]
    linked = [text[a:b] == " " or _ONE_LINE.fullmatch(text, a, b) is not None for (_, a), (b, _) in zip(spans, spans[1:], strict=False)]
    return [text[a:b] for a, b in spans], spans, [*linked, False] if spans else []


def around(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is no zone) of the islands of a text."""
    zones = sentences.zones(text)
    return [(a, b, kind == "sentence") for _, a, b, kind in document_islands(text, zones, sentences.sentence_spans(text, zones))]


def placed(islands: list[tuple[int, int, bool]], spans: Iterable[tuple[int, int]]) -> Iterator[int | None]:
    """The number of the first island that each word lies in, from 1, less than 0 for a zone."""
    z = 0
    for s, e in spans:
        while z < len(islands) and islands[z][1] <= s:
            z += 1
        yield (z + 1 if islands[z][2] else -z - 1) if z < len(islands) and islands[z][0] < e else None


def found(words: list[str], spans: list[tuple[int, int]], linked: list[bool], states: list[State], islands: Iterable[int | None], commas: bool) -> list[tuple]:
    """Each conflict of a document once, as a tuple of CONFLICT's fields; of those from one place to another the one with the first word to mend.
    States are those of all readings, and are disambiguated in place."""
    disambiguate(linked, states)
    out: dict[tuple, tuple] = {}

    def put(kind: str, first: int, last: int, target: int | None, *wanted) -> None:
        s, e = spans[first][0], spans[last][1]
        if target is None:  # a gap
            s, e = spans[first][1], spans[last][0]
            out[kind, s, e] = (kind, s, e, s, e, "", None, None, None, None)
            return
        old = out.get((kind, s, e))
        if old is None or not old[3] < spans[target][0]:
            out[kind, s, e] = (kind, s, e, *spans[target], words[target], states[target].lemma_at, *wanted)

    predicate_in, subject, subject_in = None, None, None
    for i, (a, island) in enumerate(zip(states, islands, strict=True)):
        if a.begins and linked[i]:
            n = i + 1
            while n - i < REACH and linked[n]:
                n += 1
            for kind, last, target, *wanted in relations(states[i : n + 1], states[i - 1] if i else None, words[i + 1], commas):
                put(kind, i, i + last, None if target is None else i + target, *wanted)
        if a.clause_predicate:
            if island is not None and island > 0 and predicate_in != island and subject is not None and subject_in == island and len(a.readings) == 1:
                s = states[subject]
                if len(s.readings) == 1 and _kept(predicate_conflict, s, a):
                    put("subject_predicate_agreement_basic", subject, i, i, None, s.numbers, s.genders)
            predicate_in = island if island is not None else predicate_in
        if a.clause_subject:
            subject, subject_in = i, island
    return list(out.values())


def _rows(ids: pa.Array, found_in: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Batches of conflicts, from those of each document."""
    strings = pa.list_(pa.string())
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), strings, strings, strings)
    names = [c.split()[0] for c in CONFLICT.split(", ")]
    rows = [(d, x) for d, f in enumerate(found_in) for x in f]
    for a in range(0, len(rows), ROWS):
        part = rows[a : a + ROWS]
        columns = [ids.take(pa.array([d for d, _ in part], pa.int64()))] + [pa.array([x[c] for _, x in part], k) for c, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])


def in_texts(known: dict[str, str], commas: bool):
    """A function from batches of (doc_id, text) to conflicts, by the tags of all known words."""

    def of(text: str) -> list[tuple]:
        words, spans, linked = cut(text)
        return found(words, spans, linked, [state(known.get(w), w) for w in words], placed(around(text), spans), commas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(batch.column("doc_id"), [of(t) for t in batch.column("text").to_pylist()])

    return run


def in_words(commas: bool):
    """A function from the rows of cut_rows() with tags, together and in order, to conflicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in documents_of(batches):
            ids, words, s, e, linked, island, tags = (part.column(c).to_pylist() for c in ("doc_id", "word", "s", "e", "linked", "island", "tags"))
            starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            each = []
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                each.append(found(words[a:b], list(zip(s[a:b], e[a:b], strict=True)), linked[a:b], [state(t, w) for t, w in zip(tags[a:b], words[a:b], strict=True)], island[a:b], commas))
            yield from _rows(part.column("doc_id").take(pa.array(starts, pa.int64())).combine_chunks(), each)

    return run


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, idx, word, s, e, linked, island) from (doc_id, text), one row a word."""
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            words, spans, linked = cut(text)
            if words:
                ids = batch.column("doc_id").take(pa.array([i] * len(words), pa.int64()))
                columns = [range(len(words)), words, [a for a, _ in spans], [b for _, b in spans], linked, list(placed(around(text), spans))]
                made = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *made], names=["doc_id", "idx", "word", "s", "e", "linked", "island"])


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (word) with the words of (text): each once for every KEPT distinct ones."""
    seen: set[str] = set()
    for batch in batches:
        new: set[str] = set()
        for text in batch.column("text").to_pylist():
            new.update(sentences.WORD.findall(text))
        # Punctuation is found as an empty word.
        new -= seen | {""}
        if len(seen) > KEPT:
            seen = set()
        seen |= new
        yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], names=["word"])
