"""Results as files and lines: issues as JSON or readable lines, plans, rule lists, records as JSON lines.

Everything is written by the executors, one file a partition; nothing is gathered on the driver but plans and rule lists,
which are as small as the rule table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.plans.rules import Plan, Rule


def issue_json() -> Column:
    """An issue row as a JSON object; absent values are left out."""
    place = lambda line, column: F.struct(F.col(line).alias("line"), F.col(column).alias("column"))
    span = F.struct(F.col("start_b").alias("start"), F.col("end_b").alias("end"))
    return F.to_json(F.struct("rule_id", "severity", "message", span.alias("span"), place("line", "column").alias("start"), place("end_line", "end_column").alias("end"), "replacement", "suggestion", "explanation", "source_refs", "excerpt"))


def document_json(issues: DataFrame) -> DataFrame:
    """(doc_id, json): the issues of each document as a JSON array, by place and rule."""
    order = F.struct("start_b", "end_b", "rule_id", F.coalesce("replacement", F.lit("")).alias("r"), issue_json().alias("j"))
    by = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("x"))
    return by.select("doc_id", F.concat(F.lit("["), F.array_join("x.j", ","), F.lit("]")).alias("json"))


def human_lines(issues: DataFrame) -> DataFrame:
    """(doc_id, start_b, line): each issue as a readable line, with its replacement and excerpt."""
    head = F.format_string("%s:%d:%d: [%s] %s: %s", F.col("doc_id").cast("string"), "line", "column", "severity", "rule_id", "message")
    fix = F.when(F.col("replacement").isNotNull(), F.concat(F.lit(" -> '"), "replacement", F.lit("'"))).otherwise(F.lit(""))
    return issues.select("doc_id", "start_b", F.concat(head, fix, F.lit(" | "), F.regexp_replace("excerpt", r"[\r\n]+", " ")).alias("text"))


def write_issues(issues: DataFrame, path: str, form: str = "json") -> None:
    """Writes issues as JSON lines, as readable lines (text), or as Parquet."""
    if form == "json":
        issues.select(issue_json().alias("value")).write.mode("overwrite").text(path)
    elif form == "text":
        human_lines(issues).sortWithinPartitions("doc_id", "start_b").select("text").write.mode("overwrite").text(path)
    elif form == "parquet":
        issues.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown form {form}")


def write_records(records: DataFrame, path: str) -> None:
    """Writes correction records as JSON lines with their keys in order."""
    records.select(*sorted(records.columns)).write.mode("overwrite").json(path)


def plan_json(made: Plan) -> str:
    """A plan as JSON: the rules that run and the ones left out."""
    rules = [{"rule_id": r.rule_id, "kind": r.kind, "domain": r.domain, "severity": r.severity} for r in made.rules]
    skipped = [{"rule_id": i, "reason": why, "detail": what} for i, why, what in made.skipped]
    return json.dumps({"planned": len(rules), "skipped": len(skipped), "rules": rules, "skipped_rules": skipped}, ensure_ascii=False, indent=2)


def plan_lines(made: Plan) -> list[str]:
    """A plan as readable lines."""
    out = [f"planned {len(made.rules)}, skipped {len(made.skipped)}"]
    out += [f"run\t{r.rule_id}\t{r.kind}" for r in made.rules]
    return out + [f"skip\t{i}\t{why}\t{what}" for i, why, what in made.skipped]


def rule_list(rules: list[Rule]) -> list[str]:
    """Rules as tab-separated lines."""
    return ["\t".join((r.rule_id, r.status, r.domain, r.level, r.severity, r.kind, r.message)) for r in sorted(rules, key=lambda r: r.rule_id)]
