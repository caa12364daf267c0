"""Checking documents against rules: documents and rules in, issues out.

The rules of a plan are compiled into expressions: one pass evaluates all rules over whole texts, one all over token rows,
and so on; a level that no rule needs is not built. Issues get lines, columns, byte spans and excerpts from the text that
is carried along, so nothing is joined back and nothing is shuffled until suppression, which needs no shuffle either:
directives are read from the text of the same row.

Defined results: null and empty texts give no issues; documents are checked one by one, so repeated ids are kept apart only
by their rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.functions.text import byte_offset, column_of, excerpt, line_of, token_rows
from slovotok.operators.detectors import ISSUE, REGISTRY, Hit
from slovotok.operators.document_context import abbreviations, may_be_mixed, may_repeat, structure
from slovotok.operators.sentences import fold_issues
from slovotok.plans.rules import DEFAULT_CAPABILITIES, RULES, Plan, Rule, RuleFilter, plan, rule_rows

#: Token rows by level: tokens before, tokens after, which tokens.
_LEVELS = {"token": (2, 2, "all"), "nonspace": (0, 4, "nonspace"), "word": (1, 0, "word")}


def _struct(rule: Rule, hit: Hit) -> Column:
    fields = F.struct(F.lit(rule.rule_id).alias("rule_id"), hit.start.cast("int").alias("s"), hit.end.cast("int").alias("e"), hit.replacement.cast("string").alias("replacement"))
    return F.when(hit.when, fields)


def _text_issues(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    found = F.flatten(F.array(*[REGISTRY[r.kind].build(r).cast(f"array<{ISSUE}>") for r in rules]))
    # explode_outer: for explode the optimizer would add a filter that computes the whole array a second time.
    return docs.select("doc_id", "text", F.explode_outer(found).alias("x")).filter("x is not null").select("doc_id", "text", "x.*")


def _token_issues(docs: DataFrame, rules: list[Rule], level: str) -> DataFrame:
    before, after, keep = _LEVELS[level]
    guards = [REGISTRY[r.kind].guard for r in rules]
    met = F.array(*[g(r) if g else F.lit(True) for g, r in zip(guards, rules, strict=True)])
    # Each guard is evaluated once a text; the generator keeps the optimizer from copying them. Token rows ask for the rules of met guards only.
    docs = docs.select("doc_id", "text", F.explode(F.array(met)).alias("met")).filter(F.array_contains("met", True))
    rows = token_rows(docs, ["doc_id", "text", "met"], before, after, keep)
    built = [(r, Hit(F.col("met")[i] & h.when, h.start, h.end, h.replacement)) for i, r in enumerate(rules) for h in REGISTRY[r.kind].build(r)]
    some = reduce(lambda a, b: a | b, [F.coalesce(h.when, F.lit(False)) for _, h in built])
    found = F.explode_outer(F.array(*[_struct(r, h) for r, h in built]))
    return rows.filter(some).select("doc_id", "text", found.alias("x")).filter("x is not null").select("doc_id", "text", "x.*")


def document_issues(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Issues of whole documents: style that is not kept up, and abbreviations that are used but not explained."""
    parts = []
    for r in rules:
        if r.kind == "document_style_consistency":
            made = structure(docs.filter(may_be_mixed(F.col("text"))).select("doc_id", "text"))
            cover = lambda mixed, c: F.when(mixed, F.struct(F.array_min(c["s"]).alias("s"), F.array_max(c["e"]).alias("e")))
            found = F.explode_outer(F.array(cover(F.col("mixed_markers"), F.col("items")), cover(F.col("mixed_headings"), F.col("headings"))))
            parts.append(made.filter("mixed_markers or mixed_headings").select("doc_id", "text", found.alias("x")).filter("x is not null").select("doc_id", "text", F.lit(r.rule_id).alias("rule_id"), "x.s", "x.e", F.lit(None).cast("string").alias("replacement")))
        else:
            rows = abbreviations(docs.filter(may_repeat(F.col("text"))).select("doc_id", "text")).filter("frequency > 1 and expansion is null")
            parts.append(rows.select("doc_id", "text", F.lit(r.rule_id).alias("rule_id"), "s", "e", F.lit(None).cast("string").alias("replacement")))
    return reduce(DataFrame.unionByName, parts)


#: Levels whose issues are made by a function of documents and rules.
_MADE = {"fold": fold_issues, "document": document_issues}


def raw_issues(docs: DataFrame, rules: Iterable[Rule], extra: dict[str, object] | None = None) -> DataFrame:
    """(doc_id, text, rule_id, s, e, replacement) of all rules, before suppression."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(REGISTRY[r.kind].level, []).append(r)
    docs = docs.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    # The generator keeps the optimizer from copying lower(text) into every condition that uses it.
    docs = docs.select("doc_id", "text", F.explode(F.array(F.lower("text"))).alias("low"))
    parts = []
    for level, some in by.items():
        if level == "text":
            parts.append(_text_issues(docs, some))
        elif level in _LEVELS:
            parts.append(_token_issues(docs, some, level))
        else:
            parts.append({**_MADE, **(extra or {})}[level](docs, some))
    if not parts:
        return docs.select("doc_id", "text", F.lit(None).cast(ISSUE).alias("x")).filter("x is not null").select("doc_id", "text", "x.*")
    return reduce(DataFrame.unionByName, parts)


#: The words that begin a directive, before its scope; more can be given.
MARKERS = ("slovotok-disable", "lint-disable")
_SCOPES = ("next-line", "line", "file")


def directives(text: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """The suppression directives of a text: an array of (line, scope, rules, s, e), s and e the stretch in characters from
    the marker to the end of its line. The first of each marker in a line counts; no rule ids, * or all mean all rules."""
    lines = F.split(text, "\n", -1)
    from slovotok.functions.arrays import running_sum

    starts = running_sum(F.transform(lines, lambda x: F.length(x) + 1))
    zipped = F.arrays_zip(lines.alias("line"), starts.alias("start"))

    def in_line(x: Column, i: Column) -> Column:
        line = F.regexp_replace(x["line"], r"\r+\z", "")
        found = []
        for marker in markers:
            for scope in _SCOPES:
                word = f"{marker}-{scope}"
                at = F.instr(line, word)
                tail = line.substr(at + len(word), F.length(line))
                clean = F.regexp_replace(F.regexp_replace(tail, r"^[:=(\p{IsWhite_Space}]+", ""), r"[)\->\p{IsWhite_Space}]+\z", "")
                ids = F.filter(F.split(clean, r"[\p{IsWhite_Space},;\[\](){}]"), lambda v: v != "")
                everything = (clean == "") | F.exists(ids, lambda v: (v == "*") | (F.lower(v) == "all"))
                one = F.struct(
                    (i + (2 if scope == "next-line" else 1)).cast("int").alias("line"), F.lit("file" if scope == "file" else "line").alias("scope"),
                    F.when(everything, F.array(F.lit("*"))).otherwise(ids).alias("rules"),
                    (x["start"] + at - 1).cast("int").alias("s"), (x["start"] + F.length(line)).cast("int").alias("e"),
                )
                found.append(F.when(at > 0, one))
        return F.array_compact(F.array(*found))

    kind = "array<struct<line:int,scope:string,rules:array<string>,s:int,e:int>>"
    present = reduce(lambda a, b: a | b, [text.contains(m) for m in markers])
    return F.when(present, F.flatten(F.transform(zipped, in_line))).otherwise(F.array().cast(kind))


def suppressed(rows: DataFrame, file_rules: Iterable[str] = (), inline: bool = True) -> Column:
    """Whether an issue row (text, rule_id, s, line) is suppressed: by file rules, by its line, or as it lies in a directive."""
    given = [r.strip() for r in file_rules if r.strip()]
    everywhere = F.lit(any(r == "*" or r.lower() == "all" for r in given)) | F.col("rule_id").isin(given or [""])
    if not inline:
        return everywhere
    names = lambda d: F.array_contains(d["rules"], "*") | F.array_contains(d["rules"], F.col("rule_id"))
    hit = lambda d: ((F.col("s") >= d["s"]) & (F.col("s") <= d["e"])) | (names(d) & ((d["scope"] == "file") | (d["line"] == F.col("line"))))
    return everywhere | F.exists(directives(F.col("text")), hit)


def located(raw: DataFrame) -> DataFrame:
    """Adds line and column of start and end, byte offsets and the excerpt."""
    t, s, e = F.col("text"), F.col("s"), F.col("e")
    return raw.select(
        "doc_id", "text", "rule_id", "s", "e", "replacement",
        byte_offset(t, s).alias("start_b"), byte_offset(t, e).alias("end_b"), line_of(t, s).alias("line"), column_of(t, s).alias("column"),
        line_of(t, e).alias("end_line"), column_of(t, e).alias("end_column"), excerpt(t, s, e).alias("excerpt"),
    )


def check(
    documents: DataFrame, rules: Iterable[Rule] = RULES, chosen: RuleFilter | None = None, capabilities: Iterable[str] = DEFAULT_CAPABILITIES,
    file_rules: Iterable[str] = (), inline: bool = True, extra: dict[str, object] | None = None, keep_suppressed: bool = False,
) -> DataFrame:
    """Issues of documents(doc_id, text)."""
    kinds = [k for k, d in REGISTRY.items() if d.level in (*_LEVELS, *_MADE, "text") or d.level in (extra or {})]
    made: Plan = plan(rules, chosen or RuleFilter(), kinds, capabilities)
    rows = located(raw_issues(documents, made.rules, extra)).withColumn("suppressed", suppressed(None, file_rules, inline))
    rows = rows if keep_suppressed else rows.filter(~F.col("suppressed"))
    about = rule_rows(documents.sparkSession, made.rules).select("rule_id", "severity", "message", "suggestion", "explanation", "source_refs")
    joined = rows.join(F.broadcast(about), "rule_id")
    columns = ["doc_id", "rule_id", "severity", "message", "start_b", "end_b", "line", "column", "end_line", "end_column", "replacement", "suggestion", "explanation", "source_refs", "excerpt"]
    return joined.select(*columns, *(["suppressed"] if keep_suppressed else []))
