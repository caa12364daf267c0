"""Evaluation of checking on correction records: diagnostics on inputs and on corrected targets, and what they say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of labels that mean a domain.
LABEL_PARTS = {
    "punctuation": ("punct", "comma", "запят", "пункт"),
    "orthography": ("spell", "ortho", "орф", "spelling", "hyphen", "space", "не", "жи", "ши"),
    "grammar": ("grammar", "morph", "syntax", "agr", "gov", "prep", "case", "num", "грам", "синтак"),
    "style": ("semantics", "lex", "style"),
}
# The domain that the second part of a rule id means.
RULE_DOMAINS = {"punctuation": "punctuation", "orthography": "orthography", "typography": "orthography", "grammar": "grammar", "syntax": "grammar", "style": "style"}


def label_domains(labels: Column) -> Column:
    """The domains that a record's labels mean."""
    joined = F.lower(F.array_join(F.coalesce(labels, F.array().cast("array<string>")), " "))
    return F.array_compact(F.array(*[F.when(joined.rlike("|".join(parts)), F.lit(d)) for d, parts in LABEL_PARTS.items()]))


def rule_domain(rule_id: Column) -> Column:
    """The domain of a rule."""
    out = F
    for part, domain in RULE_DOMAINS.items():
        out = out.when(rule_id.contains(f".{part}."), domain)
    return out.otherwise("unknown")


def token_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\p{IsWhite_Space}]+)"), F.lit(1)))


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n\t]+", " "))


def primary_target(correction: Column, targets: Column) -> Column:
    """The correction, else the first target, else empty."""
    first = _clean(F.try_element_at(targets, F.lit(1)))
    return F.when(_clean(correction) != "", _clean(correction)).otherwise(F.coalesce(first, F.lit("")))


def expected_dirty(text: Column, target: Column, edits: Column, labels: Column) -> Column:
    """Whether a record should have an issue: its target differs, or, without one, it has edits or labels."""
    return F.when(target != "", target != _clean(text)).otherwise(F.coalesce(edits, F.lit(False)) | (F.coalesce(F.size(labels), F.lit(0)) > 0))


def sides(records: DataFrame) -> DataFrame:
    """(rec, side, text, labels, dirty): the input of each record, and its target where it has one.

    `records` has rec, input, correction, targets, labels and has_edits."""
    target = primary_target(F.col("correction"), F.col("targets"))
    rows = records.select("rec", F.coalesce("input", F.lit("")).alias("input"), target.alias("target"), "labels", expected_dirty(F.col("input"), target, F.col("has_edits"), F.col("labels")).alias("dirty"))
    both = F.array(F.struct(F.lit("source").alias("side"), F.col("input").alias("text")), F.struct(F.lit("target").alias("side"), F.col("target").alias("text")))
    return rows.select("rec", "labels", "dirty", F.explode(both).alias("x")).select("rec", "labels", "dirty", "x.side", "x.text").filter("side = 'source' or text <> ''")


def diagnosed(records: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """sides() with the rule ids found in each text (an array, empty where none). One check runs over both sides."""
    rows = sides(records).withColumn("doc_id", F.concat_ws("|", "side", F.col("rec").cast("string")))
    found = check(rows.select("doc_id", "text")).groupBy("doc_id").agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids"))
    return rows.join(found, "doc_id", "left").withColumn("rule_ids", F.coalesce("rule_ids", F.array().cast("array<string>"))).drop("doc_id")


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(precision.isNotNull() & recall.isNotNull(), F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0)))


def report(rows: DataFrame) -> DataFrame:
    """One row of counts and proxies from diagnosed()."""
    n = F.size("rule_ids")
    src, tgt = F.col("side") == "source", F.col("side") == "target"
    domains = label_domains(F.col("labels"))
    fired = F.transform("rule_ids", rule_domain)
    of = lambda cond, value=F.lit: F.sum(F.when(cond, value).otherwise(0))
    sums = rows.agg(
        F.count_if(src).alias("examples"), F.count_if(src & F.col("dirty")).alias("expected_dirty_examples"),
        of(src, token_count(F.col("text"))).alias("source_tokens"), of(tgt, token_count(F.col("text"))).alias("target_tokens"), F.count_if(tgt).alias("targets"),
        of(src, n).alias("source_diagnostics"), of(tgt, n).alias("target_diagnostics"), F.count_if(tgt & (n > 0)).alias("false_positive_target_sentences"),
        F.count_if(src & F.col("dirty") & (n > 0)).alias("source_detected_dirty_examples"), F.count_if(src & ~F.col("dirty") & (n > 0)).alias("source_detected_clean_examples"),
        F.count_if(src & (F.size(domains) > 0)).alias("mappable_examples"), F.count_if(src & F.arrays_overlap(domains, fired)).alias("domain_hits"),
    )
    recall = F.try_divide(F.col("source_detected_dirty_examples").cast("double"), F.col("expected_dirty_examples"))
    precision = F.try_divide(F.col("source_detected_dirty_examples").cast("double"), F.col("source_detected_dirty_examples") + F.col("false_positive_target_sentences"))
    return sums.select(
        "*", F.round(rate(F.col("source_diagnostics") * 1000, F.col("examples")), 3).alias("source_per_1000_sentences"), F.round(rate(F.col("source_diagnostics") * 1000, F.col("source_tokens")), 3).alias("source_per_1000_tokens"),
        F.round(rate(F.col("target_diagnostics") * 1000, F.col("targets")), 3).alias("target_per_1000_sentences"), F.round(rate(F.col("target_diagnostics") * 1000, F.col("target_tokens")), 3).alias("target_per_1000_tokens"),
        F.round(recall, 6).alias("recall_proxy"), F.round(precision, 6).alias("precision_proxy"), F.round(fbeta(precision, recall, 0.5), 6).alias("f0_5_proxy"),
        F.round(F.try_divide(F.col("domain_hits").cast("double"), F.col("mappable_examples")), 6).alias("label_domain_hit_rate"),
    )


def by_label(rows: DataFrame) -> DataFrame:
    """(side, label, issues, records) of diagnosed(): issues and records with issues by dataset label."""
    labels = F.when(F.coalesce(F.size("labels"), F.lit(0)) == 0, F.array(F.lit("__unlabeled__"))).otherwise(F.array_distinct("labels"))
    wide = rows.filter(F.size("rule_ids") > 0).select("side", F.explode(labels).alias("label"), F.size("rule_ids").alias("n"))
    return wide.groupBy("side", "label").agg(F.sum("n").alias("issues"), F.count("*").alias("records"))


def top_rules(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent rules of each side."""
    from pyspark.sql import Window

    counts = rows.select("side", F.explode("rule_ids").alias("rule_id")).groupBy("side", "rule_id").agg(F.count("*").alias("issues"))
    order = Window.partitionBy("side").orderBy(F.desc("issues"), "rule_id")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
