"""Coordination groups: words joined by commas and conjunctions, within one island of a document.

A group is a run of words with a comma or a conjunction between each two; a conjunction may follow a comma. Groups are found in
Arrow batches, a document at a time, without a dictionary. Defined results: null texts have none; a single word is no group."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.operators.sentences import _TOKEN, sentence_spans, zones

# The conjunctions that join members.
CONJUNCTIONS = frozenset("и или либо ни да а но".split())


def member_runs(text: str) -> list[tuple[list[tuple[str, int]], list[str], bool]]:
    """(members with their starts, connectors, whether a conjunction is repeated) of the groups of a text."""
    around, out = zones(text), []
    spans = sentence_spans(text, around)
    tokens = [(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]

    # One sweep over tokens and zones: the sentence and the innermost zone of each token.
    starts, islands, inside, z = [a for a, _ in spans], [], [], 0
    for _, _, at in tokens:
        while z < len(around) and around[z][0] < at:
            inside.append(z)
            z += 1
        inside = [k for k in inside if around[k][1] > at]
        islands.append((bisect_right(starts, at), inside[-1] if inside else -1))
    member = lambda i: i < len(tokens) and tokens[i][0] == "word" and tokens[i][1].lower() not in CONJUNCTIONS
    joins = lambda i: i < len(tokens) and (tokens[i][1] == "," or tokens[i][1].lower() in CONJUNCTIONS)
    i = 0
    while i < len(tokens):
        if not member(i):
            i += 1
            continue
        members, connectors, at = [i], [], i
        while True:
            nxt = at + 1
            while joins(nxt) and islands[nxt] == islands[i] and nxt - at <= 2:
                nxt += 1
            if nxt == at + 1 or not member(nxt) or islands[nxt] != islands[i]:
                break
            connectors.append(" ".join(tokens[k][1].lower() for k in range(at + 1, nxt)))
            members.append(nxt)
            at = nxt
        if len(members) > 1:
            words = [c for c in connectors if c != ","]
            first = tokens[i - 1][1].lower() if i and islands[i - 1] == islands[i] else ""
            used = [w.split()[-1] for w in words] + ([first] if first in CONJUNCTIONS else [])
            out.append(([tokens[k][1:] for k in members], connectors, len(used) > len(set(used))))
        i = at + 1
    return out


def groups(text: str) -> list[tuple[int, int, list[str], list[str], bool]]:
    """(start, end, members, connectors, whether a conjunction is repeated) of the groups of a text."""
    return [(m[0][1], m[-1][1] + len(m[-1][0]), [w for w, _ in m], c, r) for m, c, r in member_runs(text)]


def member_gaps(text: str) -> set[tuple[int, int]]:
    """(end of a member, start of the next one) of all groups."""
    return {(a + len(w), b) for m, _, _ in member_runs(text) for (w, a), (_, b) in zip(m, m[1:])}


def shared_values(groups: DataFrame, readings: DataFrame) -> DataFrame:
    """(doc_id, s, members, cases, numbers): the cases and numbers that all members of a group can have, by their readings
    (word, cases, numbers); a member without readings leaves them open."""
    rows = groups.select("doc_id", "s", "members", F.posexplode("members").alias("i", "word"))
    known = rows.join(readings.select(F.lower("word").alias("w"), "cases", "numbers"), F.lower(rows["word"]) == F.col("w"), "left")
    by = known.groupBy("doc_id", "s", "members").agg(F.collect_list(F.struct("cases", "numbers")).alias("held"))

    def common(field: str) -> Column:
        sets = F.filter(F.transform("held", lambda h: h[field]), lambda v: F.size(v) > 0)
        return F.when(F.size(sets) > 0, F.array_sort(F.aggregate(sets, F.element_at(sets, 1), lambda a, b: F.array_intersect(a, b))))

    return by.select("doc_id", "s", "members", common("cases").alias("cases"), common("numbers").alias("numbers"))


def coordination_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, s, e, members, connectors, repeated) of the groups of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *g) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for g in groups(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "s", "e", "members", "connectors", "repeated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, s int, e int, members array<string>, connectors array<string>, repeated boolean")
