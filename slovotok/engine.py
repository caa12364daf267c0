"""The checker as one object, and helpers for single texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from slovotok.operators.checking import check
from slovotok.operators.detectors import REGISTRY
from slovotok.plans.rules import DEFAULT_CAPABILITIES, RULES, Plan, Rule, RuleFilter, plan


@dataclass(frozen=True)
class Checker:
    """What to check with; each `with_` gives a changed copy."""

    rules: tuple[Rule, ...] = RULES
    chosen: RuleFilter = field(default_factory=RuleFilter)
    capabilities: tuple[str, ...] = DEFAULT_CAPABILITIES
    file_rules: tuple[str, ...] = ()
    inline: bool = True
    extra: dict[str, Callable] = field(default_factory=dict)

    def with_rules(self, rules: Iterable[Rule]) -> Checker:
        return replace(self, rules=tuple(rules))

    def with_filter(self, **options) -> Checker:
        return replace(self, chosen=replace(self.chosen, **options))

    def with_capabilities(self, *capabilities: str) -> Checker:
        return replace(self, capabilities=tuple(dict.fromkeys([*self.capabilities, *capabilities])))

    def with_lexicon(self, lexicon: DataFrame, verbs: DataFrame | None = None) -> Checker:
        from slovotok.operators.agreement import with_lexicon

        return replace(self.with_capabilities("morphology", "lexicon"), extra={**self.extra, **with_lexicon(lexicon, verbs)})

    def with_suppression(self, *rule_ids: str, inline: bool = True) -> Checker:
        return replace(self, file_rules=(*self.file_rules, *rule_ids), inline=inline)

    def plan(self) -> Plan:
        kinds = [k for k, d in REGISTRY.items() if d.level != "lexicon" or "lexicon" in self.extra]
        return plan(self.rules, self.chosen, kinds, self.capabilities)

    def check(self, documents: DataFrame, keep_suppressed: bool = False) -> DataFrame:
        """Issues of documents(doc_id, text)."""
        return check(documents, self.rules, self.chosen, self.capabilities, self.file_rules, self.inline, self.extra, keep_suppressed)

    def check_text(self, spark: SparkSession, text: str) -> list[dict]:
        """The issues of one text, by place and rule."""
        rows = self.check(spark.createDataFrame([(0, text)], "doc_id int, text string")).orderBy("start_b", "end_b", "rule_id")
        return [{k: v for k, v in r.asDict(recursive=True).items() if k != "doc_id"} for r in rows.collect()]


def check_text(spark: SparkSession, text: str, **options) -> list[dict]:
    """The issues of one text with the rules that the library brings; options are those of RuleFilter."""
    return Checker().with_filter(**options).check_text(spark, text)
