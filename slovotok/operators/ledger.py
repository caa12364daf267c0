"""What became of each diagnosis: a ledger of emitted and suppressed issues, and counts by rule.

Both come from one run of the checker that keeps suppressed issues. Defined results: a rule of the plan without issues has counts of
zero; a rule that was skipped has the reason; repeated documents count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slovotok.operators.checking import check
from slovotok.operators.detectors import REGISTRY
from slovotok.plans.rules import DEFAULT_CAPABILITIES, RULES, Rule, RuleFilter, plan

#: The family of a kind of detector by the level at which it sees a document.
FAMILIES = {"text": "surface", "token": "surface", "nonspace": "surface", "word": "surface", "fold": "punctuation", "document": "document", "lexicon": "agreement"}
GOVERNMENT = ("preposition_government_basic", "preposition_nominal_group_government_basic", "verb_government_basic")


def contracts(rules: Iterable[Rule] = RULES) -> list[tuple[str, str, list[str], list[str], str, str]]:
    """(rule_id, family, stated, implied, signal, policy) of rules: the capabilities that a rule states and those that its detector
    needs besides, the kind of proof that it gives, and how sure it must be to be emitted."""
    out = []
    for r in rules:
        d = REGISTRY.get(r.kind)
        needs = set(d.capabilities) if d else set()
        family = "government" if r.kind in GOVERNMENT else FAMILIES.get(d.level if d else "", "unknown")
        signal = {"surface": "pattern", "punctuation": "boundary", "document": "mention", "agreement": "conflict", "government": "conflict"}.get(family, "none")
        policy = "default" if r.default_safe else "strict" if r.status == "implemented" else "never"
        out.append((r.rule_id, family, sorted(r.requires), sorted(needs - set(r.requires)), signal, policy))
    return out


def diagnostic_ledger(documents: DataFrame, rules: Iterable[Rule] = RULES, chosen: RuleFilter | None = None, extra: dict[str, object] | None = None) -> DataFrame:
    """(doc_id, n, rule_id, family, signal, start_b, end_b, line, status) of every diagnosis, numbered by place in its document."""
    rules = tuple(rules)
    about = documents.sparkSession.createDataFrame(contracts(rules), "rule_id string, family string, stated array<string>, implied array<string>, signal string, policy string")
    rows = check(documents, rules, chosen, extra=extra, keep_suppressed=True).join(F.broadcast(about), "rule_id")
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("start_b", "end_b", "rule_id")
    status = F.when(F.col("suppressed"), "suppressed").otherwise("emitted")
    return rows.select("doc_id", F.row_number().over(order).alias("n"), "rule_id", "family", "signal", "start_b", "end_b", "line", status.alias("status"))


def rule_counts(documents: DataFrame, rules: Iterable[Rule] = RULES, chosen: RuleFilter | None = None, capabilities: Iterable[str] = DEFAULT_CAPABILITIES, extra: dict[str, object] | None = None) -> DataFrame:
    """(rule_id, n_raw, n_suppressed, n_emitted, skipped) of all rules that a filter chooses."""
    rules = tuple(rules)
    lexicon = {"lexicon"} & set(extra or {})
    kinds = [k for k, d in REGISTRY.items() if d.level != "lexicon" or lexicon]
    made = plan(rules, chosen or RuleFilter(), kinds, capabilities)
    why = {rule_id: f"{reason}: {detail}" for rule_id, reason, detail in made.skipped}
    listed = documents.sparkSession.createDataFrame([*((r.rule_id, None) for r in made.rules), *why.items()], "rule_id string, skipped string")
    found = check(documents, rules, chosen, capabilities, extra=extra, keep_suppressed=True)
    by = found.groupBy("rule_id").agg(F.count("*").alias("n_raw"), F.count_if("suppressed").alias("n_suppressed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = listed.join(by, "rule_id", "left").select("rule_id", zero("n_raw"), zero("n_suppressed"), "skipped")
    return rows.select("rule_id", "n_raw", "n_suppressed", (F.col("n_raw") - F.col("n_suppressed")).alias("n_emitted"), "skipped")
