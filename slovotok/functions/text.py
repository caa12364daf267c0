"""Text expressions: tokens, normal forms, positions, excerpts. All JVM-side.

A text is cut into runs of one kind: white space, digits, word characters (letters and the joiners - ‑ – '), punctuation and
others; joined again the runs give the text. Offsets count characters; byte offsets (UTF-8) are derived for results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.functions.arrays import running_sum, shifted

_PUNCT = r"«»—–…“”„!-/:-@\[-`{-~"
TOKEN = (
    r"(?s)\p{IsWhite_Space}+|[0-9０-９]+|[\p{IsAlphabetic}\-‑–']+|[" + _PUNCT + r"]+|[^\p{IsWhite_Space}0-9０-９\p{IsAlphabetic}\-‑–'«»—…“”„!-/:-@\[-`{-~]+"
)
WHITESPACE, NUMBER, WORD, PUNCTUATION, OTHER = "whitespace", "number", "word", "punctuation", "other"
CYRILLIC = r"[\x{0400}-\x{04FF}\x{0500}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}]"


def tokenize(text: Column) -> Column:
    """The runs of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def kind(token: Column) -> Column:
    """The kind of a run, by its first character."""
    return (
        F.when(token.rlike(r"^\p{IsWhite_Space}"), WHITESPACE)
        .when(token.rlike(r"^[0-9０-９]"), NUMBER)
        .when(token.rlike(r"^[\p{IsAlphabetic}\-‑–']"), WORD)
        .when(token.rlike(rf"^[{_PUNCT}]"), PUNCTUATION)
        .when(token.isNotNull(), OTHER)
    )


def is_space(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^\p{IsWhite_Space}"), F.lit(False))


def is_word(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[\p{IsAlphabetic}\-‑–']"), F.lit(False))


def is_number(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[0-9０-９]"), F.lit(False))


def is_punctuation(token: Column) -> Column:
    return F.coalesce(token.rlike(rf"^[{_PUNCT}]") & ~is_word(token), F.lit(False))


def fold_yo(text: Column) -> Column:
    return F.translate(text, "ёЁ", "еЕ")


def lookup_key(word: Column) -> Column:
    """The key under which a dictionary holds a word: lower case, ё as е."""
    return F.translate(F.lower(word), "ё", "е")


def normalize_word(word: Column) -> Column:
    """Letters and hyphens, in lower case."""
    return F.lower(F.regexp_replace(word, r"[^\p{IsAlphabetic}-]", ""))


def has_cyrillic(text: Column) -> Column:
    return text.rlike(CYRILLIC)


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def capitalize_first(text: Column) -> Column:
    return F.concat(F.upper(text.substr(1, 1)), F.substring(text, 2, 1 << 30))


def match_case(original: Column, replacement: Column) -> Column:
    """The replacement in the case of the original: all capitals where it has no small letter, else its first letter."""
    return (
        F.when(~original.rlike(r"\p{IsLowercase}"), F.upper(replacement))
        .when(original.rlike(r"^\p{IsUppercase}"), capitalize_first(replacement))
        .otherwise(replacement)
    )


def prefix(text: Column, chars: Column) -> Column:
    """The first characters of a text."""
    return F.left(text, chars)


def byte_offset(text: Column, chars: Column) -> Column:
    """The offset in UTF-8 bytes of an offset in characters."""
    return F.octet_length(prefix(text, chars))


def line_of(text: Column, chars: Column) -> Column:
    """The line (from 1) of an offset."""
    before = prefix(text, chars)
    return F.length(before) - F.length(F.translate(before, "\n", "")) + 1


def column_of(text: Column, chars: Column) -> Column:
    """The column (from 1, in characters) of an offset."""
    return F.length(F.substring_index(prefix(text, chars), "\n", -1)) + 1


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """The sentence-like stretch around a span: after the last . ! ? or line break before it, up to the next one after it."""
    before = F.reverse(F.regexp_extract(F.reverse(prefix(text, start)), r"^[^.!?\n]*+", 0))
    after = F.regexp_extract(text.substr(end + 1, F.length(text)), r"^[^.!?\n]*+[.!?\n]?", 0)
    whole = F.concat(before, text.substr(start + 1, end - start), after)
    return F.regexp_replace(whole, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def token_rows(df: DataFrame, carry: list[str], before: int = 0, after: int = 0, keep: str = "all", text: str = "text") -> DataFrame:
    """One row a token: the carried columns, idx, t (text), s (offset in characters), e (end), p1.. (tokens before) and n1..
    (tokens after); keep "nonspace" or "word" drops other tokens first. No shuffle: neighbours are zipped as shifted arrays."""
    # Each stage refers to columns of the one before, so that no array is computed twice.
    base = df.select(*carry, tokenize(F.col(text)).alias("_toks"))
    base = base.withColumn("_lens", F.transform("_toks", lambda t: F.length(t)))
    base = base.select(*carry, "_toks", running_sum(F.col("_lens")).alias("_offs"))
    if keep != "all":
        kept = F.filter(F.arrays_zip("_toks", "_offs"), lambda z: is_word(z["_toks"]) if keep == "word" else ~is_space(z["_toks"]))
        base = base.withColumn("_kept", kept).select(*carry, F.col("_kept._toks").alias("_toks"), F.col("_kept._offs").alias("_offs"))
    zipped = [F.col("_toks").alias("t"), F.col("_offs").alias("s")]
    zipped += [shifted(F.col("_toks"), -i).alias(f"p{i}") for i in range(1, before + 1)]
    zipped += [shifted(F.col("_toks"), i).alias(f"n{i}") for i in range(1, after + 1)]
    zipped += [shifted(F.col("_offs").cast("array<string>"), -i).cast("array<int>").alias(f"ps{i}") for i in range(1, before + 1)] if keep != "all" else []
    zipped += [shifted(F.col("_offs"), i).alias(f"ns{i}") for i in range(1, after + 1)] if keep != "all" else []
    names = ["t", "s", *(f"p{i}" for i in range(1, before + 1)), *(f"n{i}" for i in range(1, after + 1))]
    if keep != "all":
        names += [*(f"ps{i}" for i in range(1, before + 1)), *(f"ns{i}" for i in range(1, after + 1))]
    wide = base.select(*carry, *[z for z in zipped])
    made = wide.select(*carry, F.posexplode_outer(F.arrays_zip(*names)).alias("idx", "z"))
    return made.select(*carry, "idx", "z.*").filter(F.col("t").isNotNull()).withColumn("e", F.col("s") + F.length("t"))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as an array of (m, s, e): text, offset and end. Matches must not be empty."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    none = F.array().cast("array<struct<m:string,s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(x["m"].alias("m"), start.alias("s"), end.alias("e"))).alias("out"))

    # One pass over gaps and matches; the gap after the last match has no match and is left out.
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), spans).otherwise(none)
