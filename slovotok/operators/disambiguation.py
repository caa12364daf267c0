"""Contextual disambiguation: readings of neighbouring words rule each other out.

The passes go left to right and change what later words see, so they are a fold over one document. It runs in Arrow batches over
one row a word: with the words of a document in one row, a batch of documents did not fit into a worker. Readings travel as their tags;
what is left of them is given by their places. A word never loses its last reading, and a pair in which nothing agrees is left alone, so that real errors
stay visible. At most PASSES passes are made; a pass that removes nothing is the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slovotok.functions.morphology import preposition_cases

PASSES = 3
#: The fields of a reading that the passes look at, and what stands between fields and between readings in a text of them.
TAGS = ("pos", "case", "number", "gender", "adjective_form", "degree", "tense", "person", "verb_form")
_FIELD, _READING = "\x1f", "\x1e"
#: Rows of a batch that goes back.
ROWS = 10_000


def _modifier(r: dict) -> bool:
    return r["pos"] in ("adjective", "participle") and r["adjective_form"] != "short" and r["degree"] != "comparative"


def _complete(r: dict) -> bool:
    return bool(r["case"] and r["number"] and (r["gender"] or r["number"] == "plural"))


def _agree(a: dict, n: dict) -> bool:
    """Whether a modifier may stand with a noun; what is unknown agrees."""
    if a["pos"] not in ("adjective", "participle") or n["pos"] != "noun" or a["degree"] == "comparative":
        return True
    if a["adjective_form"] == "short":
        return False
    same = lambda f: not a[f] or not n[f] or a[f] == n[f]
    gender = "plural" in (a["number"], n["number"]) or "common" in (a["gender"], n["gender"]) or same("gender")
    return same("case") and same("number") and gender


def _subject(r: dict) -> bool:
    return r["pos"] in ("noun", "pronoun", "numeral") and r["case"] in (None, "nominative") and bool(r["number"])


def _predicate(r: dict) -> bool:
    if r["pos"] == "verb":
        return r["verb_form"] != "infinitive" and bool(r["number"])
    return r["pos"] == "predicative" or r["pos"] == "adjective" and r["adjective_form"] == "short" and bool(r["number"])


def _fit(s: dict, p: dict) -> bool:
    """Whether a subject and a predicate certainly agree."""
    if not (_subject(s) and _predicate(p)) or s["number"] != p["number"]:
        return False
    person = "third" if s["pos"] == "noun" else s["person"]
    if p["person"] and person != p["person"]:
        return False
    if p["tense"] == "past" and p["number"] == "singular":
        return bool(s["gender"] and p["gender"]) and (s["gender"] == p["gender"] or "common" in (s["gender"], p["gender"]))
    return True


def prune(words: list[str], linked: list[bool], readings: list[list[dict]]) -> list[tuple[int, dict, str, int]]:
    """Removes readings in place; (word, reading, constraint, evidence word) of each removal. `linked` tells whether a word
    follows a word with only white space between."""
    out: list[tuple[int, dict, str, int]] = []
    cases = preposition_cases()

    def remove(i: int, test, why: str, by: int) -> None:
        gone = [r for r in readings[i] if test(r)]
        if gone and len(gone) < len(readings[i]):
            out.extend((i, r, why, by) for r in gone)
            readings[i] = [r for r in readings[i] if not test(r)]

    n = len(words)
    for _ in range(PASSES):
        before = len(out)
        for i in range(n - 1):
            if not linked[i] or not readings[i] or any(r["pos"] != "preposition" for r in readings[i]):
                continue
            remove(i + 1, lambda r: r["pos"] in ("verb", "gerund"), "preposition_verb_exclusion", i)
            allowed = cases.get(words[i].lower())
            if allowed:
                remove(i + 1, lambda r, a=allowed: bool(r["case"]) and r["case"] not in a, "preposition_case_government", i)
        for i in range(n - 1):
            if not linked[i]:
                continue
            left, right = readings[i], readings[i + 1]
            sure_left = bool(left) and all(_modifier(r) and _complete(r) for r in left)
            sure_right = bool(right) and all(r["pos"] == "noun" and _complete(r) for r in right)
            if not (sure_left or sure_right) or not any(_modifier(a) and b["pos"] == "noun" and _agree(a, b) for a in left for b in right):
                continue
            if sure_left:
                remove(i + 1, lambda r, o=list(left): r["pos"] == "noun" and _complete(r) and not any(_agree(a, r) for a in o), "modifier_head_agreement", i)
            if sure_right:
                remove(i, lambda r, o=list(readings[i + 1]): _modifier(r) and _complete(r) and not any(_agree(r, b) for b in o), "modifier_head_agreement", i + 1)
        for i in range(n - 1):
            if not linked[i] or i and linked[i - 1]:
                continue
            left, right = readings[i], readings[i + 1]
            sure_left, sure_right = bool(left) and all(map(_subject, left)), bool(right) and all(map(_predicate, right))
            if not (sure_left or sure_right) or not any(_fit(a, b) for a in left for b in right):
                continue
            if sure_left:
                remove(i + 1, lambda r, o=list(left): not any(_fit(a, r) for a in o), "subject_predicate_agreement", i)
            if sure_right:
                remove(i, lambda r, o=list(readings[i + 1]): not any(_fit(r, b) for b in o), "subject_predicate_agreement", i + 1)
        if len(out) == before:
            break
    return out


def tagged(memo: DataFrame) -> DataFrame:
    """(word, tags): what prune() looks at in the readings of memo(word, r), in their order, as one text."""
    one = lambda r: F.concat_ws(_FIELD, *[F.coalesce(r[f], F.lit("")) for f in TAGS])
    return memo.select("word", F.array_join(F.transform("r", one), _READING).alias("tags"))


@lru_cache(maxsize=1 << 16)
def _parsed(tags: str | None) -> list[dict]:
    if tags is None:
        return []
    return [dict(zip(TAGS, (v or None for v in r.split(_FIELD)), strict=True)) | {"at": i} for i, r in enumerate(tags.split(_READING))]


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are in order of doc_id, as tables of whole documents: no more is held than a batch and the document at its end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        if not ids:
            continue
        cut = len(ids)
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if held and (cut or last != ids[-1]):
            if ids[0] != last:
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = ids[-1]
    if held:
        yield pa.Table.from_batches(held)


def _in_order(words: DataFrame, memo: DataFrame, small: bool) -> DataFrame:
    """The words of each document together and in order, one row a word, so that a batch is small whatever a document holds;
    tags stand in for the readings. A small memo is broadcast, so that words stay in the order in which texts were cut."""
    columns = ("doc_id", "idx", "word", "s", "e", "linked", "tags")
    if small:
        return words.join(F.broadcast(memo), "word", "left").select(*columns)
    return words.join(memo, "word", "left").select(*columns).repartition("doc_id").sortWithinPartitions(*columns[:-1])


def _pruned(part: pa.Table) -> Iterator[tuple[int, list[str], list[list[dict]], list[tuple[int, dict, str, int]]]]:
    """(first row, words, readings left, removals) of each document of a table of documents_of()."""
    ids, words, linked, tags = (part.column(c).to_pylist() for c in ("doc_id", "word", "linked", "tags"))
    a = 0
    while a < len(ids):
        b = a + 1
        while b < len(ids) and ids[b] == ids[a]:
            b += 1
        left = [_parsed(t) for t in tags[a:b]]
        gone = prune(words[a:b], [bool(x) for x in linked[a:b]], left)
        yield a, words[a:b], left, gone
        a = b


def disambiguated(words: DataFrame, memo: DataFrame, small: bool) -> DataFrame:
    """words(doc_id, idx, word, s, e, linked), as token_rows() makes them, with `kept`: the places of the readings of memo(word, tags)
    that are left, null where all are."""
    kind = words.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in documents_of(batches):
            kept: list[list[int] | None] = [None] * part.num_rows
            for at, _, left, gone in _pruned(part):
                for i in {i for i, *_ in gone}:
                    kept[at + i] = [r["at"] for r in left[i]]
            made = part.drop_columns("tags").append_column("kept", pa.array(kept, pa.list_(pa.int32())))
            yield from made.to_batches(max_chunksize=ROWS)

    return _in_order(words, memo, small).mapInArrow(run, f"doc_id {kind}, idx int, word string, s int, e int, linked boolean, kept array<int>")


def eliminations(words: DataFrame, memo: DataFrame, small: bool) -> DataFrame:
    """(doc_id, idx, word, at, constraint, evidence) of every reading that is ruled out, `at` its place in memo(word, tags)."""
    kind = words.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in documents_of(batches):
            rows, evidence, ats, why = [], [], [], []
            for at, words_, _, gone in _pruned(part):
                for i, r, reason, by in gone:
                    rows.append(at + i)
                    ats.append(r["at"])
                    why.append(reason)
                    evidence.append(words_[by])
            made = part.select(["doc_id", "idx", "word"]).take(pa.array(rows, pa.int64()))
            made = made.append_column("at", pa.array(ats, pa.int32())).append_column("constraint", pa.array(why, pa.string())).append_column("evidence", pa.array(evidence, pa.string()))
            yield from made.to_batches(max_chunksize=ROWS)

    return _in_order(words, memo, small).mapInArrow(run, f"doc_id {kind}, idx int, word string, at int, constraint string, evidence string")
