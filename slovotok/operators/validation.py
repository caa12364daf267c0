"""Validation: tables of violations of the rule table, its examples and the grammar seeds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slovotok.operators.checking import check
from slovotok.operators.detectors import REGISTRY
from slovotok.plans.rules import CAPABILITIES, DOMAINS, LEVELS, SEVERITIES, STATUSES, Rule, RuleFilter


def rule_violations(rules: Iterable[Rule]) -> list[tuple[str, str]]:
    """(rule_id, problem) of the rules that break the contract."""
    rules, out = list(rules), []
    for rule_id, n in Counter(r.rule_id for r in rules).items():
        if n > 1:
            out.append((rule_id, "duplicate_id"))
    for r in rules:
        checks = {
            "id_shape": re.fullmatch(r"ru\.[a-z_]+\.[a-z0-9_]+", r.rule_id), "domain": r.domain in DOMAINS, "level": r.level in LEVELS, "severity": r.severity in SEVERITIES, "status": r.status in STATUSES,
            "requires": set(r.requires) <= set(CAPABILITIES), "message": r.message.strip(), "implemented_is_manual": r.status != "implemented" or r.kind != "manual",
            "capability_of_detector": r.kind not in REGISTRY or set(REGISTRY[r.kind].capabilities) <= set(r.requires) or r.status != "implemented", "examples_overlap": not set(r.valid) & set(r.invalid),
            "examples": r.status != "implemented" or r.kind == "manual" or (r.valid and r.invalid),
        }
        out += [(r.rule_id, problem) for problem, good in checks.items() if not good]
    return sorted(out)


def example_failures(spark: SparkSession, rules: Iterable[Rule], extra: dict[str, object] | None = None) -> DataFrame:
    """(rule_id, expected, text) of the examples that do not fire or stay silent as stated. One check runs over all examples."""
    rules = [r for r in rules if r.status == "implemented" and r.kind in REGISTRY and (REGISTRY[r.kind].level != "lexicon" or "lexicon" in (extra or {}))]
    rows = [(f"{r.rule_id}|{e}|{i}", r.rule_id, e, t) for r in rules for e, ts in (("fires", r.invalid), ("silent", r.valid)) for i, t in enumerate(ts)]
    examples = spark.createDataFrame(rows, "doc_id string, rule_id string, expected string, text string")
    found = check(examples.select("doc_id", "text"), rules, RuleFilter("strict"), extra=extra).select("doc_id", "rule_id").distinct().withColumn("fired", F.lit(True))
    joined = examples.join(found, ["doc_id", "rule_id"], "left")
    return joined.filter((F.col("expected") == "fires") != F.coalesce("fired", F.lit(False))).select("rule_id", "expected", "text")


def government_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, problem) of government rows: unknown kinds, missing lemmas or cases, prepositions that should or should not be there,
    and keys that occur more than once."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    kind = F.coalesce("complement_kind", F.lit(""))
    checks = {
        "unknown_kind": ~kind.isin("direct_object", "prepositional_object"), "preposition_missing": (kind == "prepositional_object") & empty("preposition"),
        "preposition_not_expected": (kind == "direct_object") & ~empty("preposition"), "lemma_missing": empty("lemma"), "cases_missing": empty("cases"),
    }
    wrong = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))
    out = rows.select(F.col(key), wrong.alias("problem"))
    identity = [F.trim(F.coalesce("lemma", F.lit(""))), kind, F.trim(F.coalesce("preposition", F.lit("")))]
    same = rows.select(F.col(key), F.count("*").over(Window.partitionBy(*identity)).alias("n"))
    return out.unionByName(same.filter("n > 1").select(key, F.lit("duplicate_key").alias("problem")))


def entries_without_fixture(seed: DataFrame, fixtures: DataFrame, keys: tuple[str, ...] = ("lemma", "complement_kind", "preposition")) -> DataFrame:
    """Seed rows for which there is no fixture."""
    blank = lambda df: df.select(*[F.coalesce(F.trim(F.col(k)), F.lit("")).alias(k) for k in keys])
    return blank(seed).distinct().join(blank(fixtures).distinct(), list(keys), "left_anti")
