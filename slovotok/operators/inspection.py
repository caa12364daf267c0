"""Inspection: what the layers found in each document, and dumps of tokens with their readings, limited per document.

Counts are made within the row of each document; dumps keep the first rows of each document by a row number, so that a
limit per document needs no sort over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slovotok.functions.text import is_word, normalize_word, tokenize
from slovotok.operators import document_context, sentences

# Limits of a dump.
TOKENS, READINGS = 256, 8


def safe_zones(docs: DataFrame) -> DataFrame:
    """(doc_id, s, e, kind): closed brackets and quotes of each document."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [(d, a, b, k) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for a, b, k in sentences.zones(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "s", "e", "kind"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter(F.col("text").rlike(r"[(\[{«„“\"]")).select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, s int, e int, kind string")


def document_islands(text: str, around: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
    """(sentence, from, to, kind) of the stretches of one document within which words may be linked."""
    found, z = [], 0
    for n, (a, b) in enumerate(spans, 1):
        at = a
        while z < len(around) and around[z][0] < a:
            z += 1
        while z < len(around) and around[z][0] < b:
            x, y, k = around[z]
            z += 1
            if x < at or y > b:
                continue
            if text[at:x].strip():
                found.append((n, at, x, "sentence"))
            found.append((n, x, y, k))
            at = y
        if text[at:b].strip():
            found.append((n, at, b, "sentence"))
    return found


def islands(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sentence, s, e, kind): the stretches within which words may be linked: sentences without their zones, and the
    zones, which are islands of their own. Words are linked only within one island."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                around = sentences.zones(t)
                rows += [(d, i, *f) for i, f in enumerate(document_islands(t, around, sentences.sentence_spans(t, around)))]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "sentence", "s", "e", "kind"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, n int, sentence int, s int, e int, kind string")


def fact_counts(docs: DataFrame) -> DataFrame:
    """One row a document: how many facts each layer has. Each document is folded once and cut into tokens once; nothing is joined."""
    import pandas as pd

    folded = ("sentences", "parentheticals", "direct_speech", "islands", "clause_markers")

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                around = sentences.zones(t)
                spans = sentences.sentence_spans(t, around)
                kinds = [k for _, _, k in around]
                rows.append((d, t, len(spans), kinds.count("parenthetical"), kinds.count("direct_speech"), len(document_islands(t, around, spans)), len(sentences.clause_boundaries(t))))
            yield pd.DataFrame(rows, columns=["doc_id", "text", *folded])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = docs.filter("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, text string, " + ", ".join(f"{c} bigint" for c in folded))
    made = document_context.structure(made).withColumn("_tokens", tokenize(F.col("text"))).drop("text")
    made = made.withColumn("_words", F.filter("_tokens", is_word))
    terms = F.filter(F.transform("_words", normalize_word), lambda w: (F.length(w) >= 4) & ~w.isin(document_context.STOP_WORDS))
    shorts = F.filter(F.transform(F.filter("_words", lambda w: ~w.rlike(r"\p{IsLowercase}")), lambda w: F.upper(F.regexp_replace(w, r"\P{IsAlphabetic}", ""))), lambda w: F.length(w).between(2, 10))
    counted = {"tokens": F.size("_tokens"), "words": F.size("_words"), "headings": F.size("headings"), "list_items": F.size("items"), "paragraphs": F.col("paragraphs"), "terms": F.size(F.array_distinct(terms)), "abbreviations": F.size(F.array_distinct(shorts))}
    order = ("tokens", "words", "sentences", "parentheticals", "direct_speech", "islands", "clause_markers", "headings", "list_items", "paragraphs", "terms", "abbreviations")
    return made.select("doc_id", *[counted.get(c, F.col(c)).cast("bigint").alias(c) for c in order])


def token_dump(readings: DataFrame, tokens: int = TOKENS, most: int = READINGS) -> DataFrame:
    """The first tokens of each document of token_readings(), each with its first readings."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    return readings.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= tokens).withColumn("readings", F.slice("readings", 1, most)).drop("n")


#: Facts of each layer that a report holds.
FACTS = 256


#: The layers of a report and the fields of a fact of each.
LAYERS = {
    "tokens": ("kind", "text", "start", "end"), "sentences": ("start", "end"), "zones": ("start", "end", "kind"), "islands": ("sentence", "start", "end", "kind"),
    "clause_markers": ("start", "end", "marker", "kind", "confidence"), "coordination_groups": ("start", "end", "members", "connectors", "repeated"),
    "slots": ("start", "end", "left", "right", "island", "marks", "expected", "forbidden", "strength", "blockers"),
}
#: Characters of texts whose reports go back together; a batch holds as many documents as it likes, and their reports much more than their texts.
PART = 1 << 18


def _facts(text: str) -> dict[str, list]:
    """All facts of each layer of a text, as tuples of the fields of LAYERS."""
    from slovotok.operators import coordination, links

    around = sentences.zones(text)
    spans = sentences.sentence_spans(text, around)
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in sentences._TOKEN.finditer(text)]
    return dict(zip(LAYERS, (tokens, spans, around, document_islands(text, around, spans), sentences.clause_boundaries(text), coordination.groups(text), links.document_slots(text)), strict=True))


def _parts(batches):
    """(doc_ids, texts) of as many rows as have PART characters, one at least."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for d, t in zip(batch["doc_id"], batch["text"], strict=True):
            if ids and held + len(t) > PART:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(d)
            texts.append(t)
            held += len(t)
        if ids:
            yield ids, texts


def debug_reports(docs: DataFrame, tokens: int = TOKENS, facts: int = FACTS) -> DataFrame:
    """(doc_id, report): one JSON object a document: how many facts each layer has, and the first of each with their places. Made in
    one fold of the document; the limits say what is shown, all of it is counted."""
    import json

    import pandas as pd

    def report(text: str) -> str:
        found, limit = _facts(text), {"tokens": tokens}
        shown = {k: [dict(zip(LAYERS[k], x, strict=True)) for x in v[: limit.get(k, facts)]] for k, v in found.items()}
        return json.dumps({"format": 1, "characters": len(text), "counts": {k: len(v) for k, v in found.items()}} | shown, ensure_ascii=False)

    def run(batches):
        for ids, texts in _parts(batches):
            yield pd.DataFrame({"doc_id": ids, "report": [report(t) for t in texts]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, report string")


def debug_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, characters, and how many facts each layer has) of debug_reports(), without what the reports show."""
    import pandas as pd

    def run(batches):
        for ids, texts in _parts(batches):
            yield pd.DataFrame([(d, len(t), *map(len, _facts(t).values())) for d, t in zip(ids, texts, strict=True)], columns=["doc_id", "characters", *LAYERS])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, characters bigint, " + ", ".join(f"{c} bigint" for c in LAYERS))
