"""Word formation: words as prefixes, a root, suffixes and an ending, with a score.

Each distinct word is cut once, in Arrow batches; the inventory is fixed and small. Parses are all splits with at most two
prefixes, a known root, at most four suffixes and an ending; the eight best are kept, and a word without any gets itself as an
unknown root. Defined results: null words and words of fewer than two letters have no parse; repeated words count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The seed morphemes.
PREFIXES = "без бес вз вс воз вос из ис низ нис раз рас роз рос через черес чрез чрес по под над пере при про с со у до на о об от за".split()
ROOTS = "би бив вод воз город дел дом друг звук зем ид имен книг лимон лес люб москв пис пись прав род рус сказ слов смерт смотр уч ход чит язык яблок".split()
SUFFIXES = "а и е ова ева ыва ива тель ник ниц чик щик ость ств ск н ов ев еньк оньк к очк ечк изм ть л".split()
ENDINGS = "ами ями ого ему ыми ими ой ый ий ая ое ые ие ом ем ам ям ах ях ов ев ей а я о е ы и у ю ь".split()
MOST_PREFIXES, MOST_SUFFIXES, MOST_PARSES = 2, 4, 8


def _chains(text: str, parts: list[str], most: int, whole: bool) -> list[tuple[str, ...]]:
    """Ways to take at most `most` parts off the front of a text; with `whole` they must use it up."""
    found, open_ = [], [()]
    for _ in range(most + 1):
        found += [c for c in open_ if not whole or len("".join(c)) == len(text)]
        open_ = [(*c, p) for c in open_ for p in parts if text.startswith(p, len("".join(c)))]
    return found


def parses(word: str) -> list[tuple[int, str, list[str], str | None, list[str], str]]:
    """(score, signature, prefixes, root, suffixes, ending) of the best parses of a word."""
    word = word.lower()
    if sum(c.isalpha() for c in word) < 2:
        return []
    out = {}
    for ending in [e for e in ENDINGS if word.endswith(e)] + [""]:
        base = word[: len(word) - len(ending)]
        for prefixes, root in product(_chains(base, PREFIXES, MOST_PREFIXES, False), ROOTS):
            at = len("".join(prefixes))
            if not base.startswith(root, at):
                continue
            for suffixes in _chains(base[at + len(root) :], SUFFIXES, MOST_SUFFIXES, True):
                known = len(prefixes) + 1 + len(suffixes) + bool(ending)
                score = 50 + 8 * known + 4 * len(prefixes) + 3 * len(suffixes)
                parts = [*(("prefix", p) for p in prefixes), ("root", root), *(("suffix", s) for s in suffixes), *([("ending", ending)] if ending else [])]
                signature = "+".join(f"{k}:{v}" for k, v in parts)
                out[signature] = (score, signature, list(prefixes), root, list(suffixes), ending)
    if not out:
        return [(5, f"root:{word}", [], word, [], "")]
    return sorted(out.values(), key=lambda x: (-x[0], x[1]))[:MOST_PARSES]


def word_formation(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, rank, score, confidence, signature, prefixes, root, suffixes, ending) of each distinct word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, i, *p) for w in batch["word"] for i, p in enumerate(parses(w), 1)]
            yield pd.DataFrame(rows, columns=["word", "rank", "score", "signature", "prefixes", "root", "suffixes", "ending"])

    distinct = words.select(F.lower(F.col(column)).alias("word")).filter("word is not null").distinct()
    made = distinct.mapInPandas(run, "word string, rank int, score int, signature string, prefixes array<string>, root string, suffixes array<string>, ending string")
    known = F.col("score") >= 50
    return made.withColumn("confidence", F.when(F.col("score") >= 70, "high").when(known, "medium").otherwise("low"))
