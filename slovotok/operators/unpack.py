"""Several values packed in one field: one value a row, with its position.

The field's ordinary characters are masked, which leaves its delimiter skeleton: runs of letters and digits, stretches in double
quotes, words that join when they stand by themselves, and all other characters as they are. What joins and what belongs to a
value is resolved once per distinct skeleton: which of the chunks between separators are values, which of them an equals sign
with spaces around it makes one value, and which hold quotes. The rules are written once, measured, and broadcast if they are
small (joined by shuffle otherwise); then they are applied by the positions of the chunks. Several tables are unpacked together.

Defined results: a null field gives no row, an empty one or one of joiners only gives none either; repeated values are
kept; an unmatched quote is an ordinary character; a chunk of marks only joins; fields of any length are cut without recursion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.session import checkpoint, small_enough

#: Characters that join values. Hyphens, dots, underscores, equals signs and colons belong to values if they touch any.
JOINERS = r"\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}|;,/&\\+"
#: Words that join values when they stand by themselves.
JOINING_WORDS = ("и", "или", "либо", "and", "or")

#: Masks: an ordinary run, a quoted stretch, an empty one, a joining word.
ORDINARY, QUOTED, EMPTY, WORD = "a", "\x01", "\x02", "\x03"
#: All of JOINERS one by one; \s is these six.
_SINGLE = " \t\n\x0b\f\r\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u3000|;,/&\\+"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_CHUNK = rf'(?:{_QUOTED}|[^{JOINERS}"]++|")++'


def chunks(value: Column) -> Column:
    """The chunks of a field between joining characters; stretches in quotes are never cut."""
    whole = F.regexp_extract_all(value, F.lit(f"({_CHUNK})"), F.lit(1))
    # Without quotes one joiner stands for all, and a single character is cut at without a regular expression.
    return F.when(value.contains('"'), whole).otherwise(F.array_remove(F.split(F.translate(value, _SINGLE, "|" * len(_SINGLE)), r"\|"), ""))


def skeleton(value: Column) -> Column:
    """The field with its ordinary characters masked."""
    plain = F.translate(value, QUOTED + EMPTY + WORD, ORDINARY * 3)
    plain = F.when(plain.contains('"'), F.regexp_replace(F.regexp_replace(plain, r'(?<!")""(?!")', EMPTY), _QUOTED, QUOTED)).otherwise(plain)
    lower = F.lower(plain)
    some = reduce(Column.__or__, [lower.contains(w) for w in JOINING_WORDS])
    words = F.when(some, F.regexp_replace(plain, rf"(?iu)(?<![^{JOINERS}])(?:{'|'.join(JOINING_WORDS)})(?![^{JOINERS}])", WORD)).otherwise(plain)
    return F.regexp_replace(words, r"[\p{L}\p{N}\p{M}_]++", ORDINARY)


_SEPARATORS = re.compile(r"([\s\xa0\u2000-\u200a\u202f\u3000|;,/&\\+]+)")
#: From the first to the last chunk of a value (counted from 1), and whether it may hold quotes.
RULE = "array<struct<first: int, last: int, quoted: boolean>>"


def resolve(skel: str) -> list[tuple[int, int, bool]]:
    """The splitting rule of a skeleton: the values as ranges of its chunks."""
    values: list[tuple[int, int, bool]] = []
    at, open_sign, spaces = 0, False, False
    for part in _SEPARATORS.split(skel):
        if not part:
            continue
        if _SEPARATORS.fullmatch(part):
            spaces = part.isspace()
            continue
        at += 1
        sign, has_value, quoted = part == "=", any(x in part for x in (ORDINARY, QUOTED, '"')), '"' in part or QUOTED in part or EMPTY in part
        # An equals sign with spaces around it still makes key and value one.
        joins = values and spaces and values[-1][1] == at - 1 and (sign or has_value and (open_sign or part.startswith("=")))
        if joins:
            values[-1] = (values[-1][0], at, values[-1][2] or quoted)
        elif has_value:
            values.append((at, at, quoted))
        open_sign = part.endswith("=") and bool(joins or has_value)
    return values


def splitting_rules(skeletons: DataFrame) -> DataFrame:
    """(skel, rule, plain) of each distinct skeleton; plain ones have every chunk as a value, without quotes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rules = [resolve(s) for s in batch["skel"]]
            plain = [r == [(i, i, False) for i in range(1, len(r) + 1)] and len(r) == sum(bool(p) for p in _SEPARATORS.split(s)[::2]) for s, r in zip(batch["skel"], rules, strict=True)]
            yield pd.DataFrame({"skel": batch["skel"], "rule": [[{"first": a, "last": b, "quoted": q} for a, b, q in r] for r in rules], "plain": plain})

    return skeletons.mapInPandas(run, f"skel string, rule {RULE}, plain boolean")


def unquoted(value: Column) -> Column:
    """The value without the quotes around its quoted stretches; a doubled quote inside one stands for one."""
    parts = F.regexp_extract_all(value, F.lit(rf'({_QUOTED}|[^"]++|")'), F.lit(1))
    strip = lambda p: F.when((F.length(p) > 1) & p.startswith('"'), F.replace(p.substr(F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p)
    return F.array_join(F.transform(parts, strip), "")


def unpack_all(fields: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, key, pos, val) of several (name, rows, key, field): each value of each field, its position counted from 1."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("tbl"), F.col(k).alias("key"), F.col(f).alias("value")).filter("value is not null") for n, df, k, f in fields])
    rows = rows.withColumn("skel", skeleton(F.col("value")))
    rules = checkpoint(splitting_rules(rows.select("skel").distinct()))
    small = small_enough(rules.select(F.concat("skel", F.repeat(F.lit("x"), 16 * F.size("rule"))).alias("s")), "s")
    # A left join, as for an inner one the optimizer would add a filter that computes the skeletons a second time.
    rows = rows.join(F.broadcast(rules) if small else rules, "skel", "left").select("tbl", "key", "rule", "plain", chunks(F.col("value")).alias("cut"))
    piece = lambda r: F.when(r["first"] == r["last"], F.element_at("cut", r["first"])).otherwise(F.array_join(F.slice("cut", r["first"], r["last"] - r["first"] + 1), ""))
    picked = F.transform("rule", lambda r: F.when(r["quoted"], unquoted(piece(r))).otherwise(piece(r)))
    values = rows.select("tbl", "key", F.when(F.col("plain"), F.col("cut")).otherwise(picked).alias("values"))
    # posexplode_outer: for posexplode the optimizer would add a filter that computes the values a second time.
    return values.select("tbl", "key", F.posexplode_outer("values").alias("p", "val")).filter("val is not null").select("tbl", "key", (F.col("p") + 1).cast("int").alias("pos"), "val")


def unpack(rows: DataFrame, key: str, field: str) -> DataFrame:
    """(key, pos, val): each value of one field."""
    return unpack_all([("", rows, key, field)]).select(F.col("key").alias(key), "pos", "val")
