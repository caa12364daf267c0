"""What a document says about itself: headings, list items, style, glossary, terms and abbreviations.

Lines are an array per document, so headings, items, style and glossary need no shuffle. Terms and abbreviations are counted
by document and word with partial aggregation; only counts and first places move. Abbreviations are counted within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.functions.arrays import running_sum
from slovotok.functions.text import is_word, normalize_word, token_rows, tokenize

# Words that are no terms.
STOP_WORDS = "который которая которые потому если чтобы этого этот эта это были было есть будет можно нужно".split()
_TRIM = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
_LEADING = r"^\p{IsWhite_Space}+"


def _ends(text: Column) -> Column:
    return text.rlike(r"[.!?:;]\z")


def with_lines(docs: DataFrame) -> DataFrame:
    """docs with lines: an array of (n, s, e, raw), lines counted from 1, offsets in characters."""
    base = docs.withColumn("_parts", F.split("text", "\n", -1))
    base = base.withColumn("_starts", running_sum(F.transform("_parts", lambda x: F.length(x) + 1)))
    made = F.transform(F.arrays_zip("_parts", "_starts"), lambda z, i: F.struct((i + 1).alias("n"), z["_starts"].alias("s"), (z["_starts"] + F.length(z["_parts"])).alias("e"), z["_parts"].alias("raw")))
    return base.withColumn("lines", made).drop("_parts", "_starts")


def list_marker(line: Column) -> Column:
    """The kind of list marker that a line without leading space begins with: dash, asterisk, bullet or numbered; else null."""
    return F.when(line.startswith("- "), "dash").when(line.startswith("* "), "asterisk").when(line.startswith("• "), "bullet").when(line.rlike(r"^[0-9]+\. "), "numbered")


def list_items(lines: Column) -> Column:
    """(n, s, e, marker, body, terminal) of the lines that are list items."""

    def item(x: Column) -> Column:
        cut = F.regexp_replace(x["raw"], _LEADING, "")
        body = F.regexp_replace(cut.substr(F.instr(cut, " ") + 1, F.length(cut)), _TRIM, "")
        return F.struct(x["n"].alias("n"), (x["e"] - F.length(cut)).alias("s"), x["e"].alias("e"), list_marker(cut).alias("marker"), body.alias("body"), _ends(body).alias("terminal"))

    return F.filter(F.transform(lines, item), lambda x: x["marker"].isNotNull())


def headings(lines: Column) -> Column:
    """(n, s, e, title, style, terminal) of the lines that are headings: marked by #, or short, without an end and no list item."""

    def heading(x: Column) -> Column:
        cut = F.regexp_replace(x["raw"], _TRIM, "")
        lead = F.length(x["raw"]) - F.length(F.regexp_replace(x["raw"], _LEADING, ""))
        title = F.regexp_replace(F.regexp_replace(cut, "^#+", ""), _TRIM, "")
        marked = cut.startswith("#")
        plain = (cut != "") & (F.length(cut) <= 80) & ~_ends(cut) & list_marker(cut).isNull()
        style = F.when(marked, "marked").when(plain, "plain")
        return F.struct(x["n"].alias("n"), (x["s"] + lead).alias("s"), x["e"].alias("e"), F.when(marked, title).otherwise(cut).alias("title"), style.alias("style"), (marked & _ends(title)).alias("terminal"))

    return F.filter(F.transform(lines, heading), lambda x: x["style"].isNotNull())


def structure(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with headings, items and the style profile."""
    base = with_lines(docs.filter("text is not null")).withColumn("headings", headings(F.col("lines"))).withColumn("items", list_items(F.col("lines"))).drop("lines")
    differ = lambda c: F.size(F.array_distinct(c)) > 1
    paragraphs = F.size(F.filter(F.split("text", "\n\n", -1), lambda p: F.regexp_replace(p, _TRIM, "") != ""))
    return base.withColumns({"paragraphs": paragraphs, "mixed_headings": differ(F.col("headings.terminal")), "mixed_markers": differ(F.col("items.marker"))})


def may_be_mixed(text: Column) -> Column:
    """A condition that every text with mixed headings or markers meets: a heading that may have an end, or two kinds of list markers."""
    line = lambda begin: text.rlike(rf"(?:^|\n)\p{{IsWhite_Space}}*+{begin}")
    kinds = [F.coalesce(line(m), F.lit(False)).cast("int") for m in ("- ", r"\* ", "• ", r"[0-9]+\. ")]
    return line("#") | (kinds[0] + kinds[1] + kinds[2] + kinds[3] > 1)


def may_repeat(text: Column) -> Column:
    """A condition that every text meets in which an abbreviation occurs twice: two words with letters side by side that are not small."""
    letter = r"[\p{IsAlphabetic}&&[^\p{IsLowercase}]]"
    pair = rf"{letter}[\-‑–']*+{letter}"
    return text.rlike(rf"(?s){pair}[\p{{IsAlphabetic}}\-‑–']*+.*?{pair}")


def glossary(docs: DataFrame) -> DataFrame:
    """(doc_id, term, definition, s, e): list items below a glossary heading, up to the next heading."""
    base = structure(docs)
    following = F.transform("headings", lambda h, i: F.struct(h["title"].alias("title"), h["e"].alias("a"), F.coalesce(F.try_element_at(F.col("headings"), i + 2)["s"], F.length("text")).alias("b")))
    ranges = F.filter(following, lambda h: F.lower(h["title"]).contains("глоссар"))
    base = base.withColumn("ranges", ranges)
    inside = F.filter("items", lambda x: F.exists("ranges", lambda r: (r["a"] <= x["s"]) & (x["s"] < r["b"])))
    rows = base.select("doc_id", F.explode(inside).alias("x"))

    def part(i: int) -> Column:
        out = F
        for sep in (" — ", " – ", " - ", ": "):
            at = F.instr("x.body", sep)
            left, right = F.col("x.body").substr(F.lit(1), at - 1), F.col("x.body").substr(at + len(sep), F.length("x.body"))
            good = (at > 0) & (F.trim(left) != "") & (F.trim(right) != "")
            out = out.when(good, F.trim((left, right)[i]))
        return out

    return rows.select("doc_id", part(0).alias("term"), part(1).alias("definition"), F.col("x.s").alias("s"), F.col("x.e").alias("e")).filter("term is not null")


def terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, frequency, first_start): words of four letters at least that are no stop words."""
    rows = token_rows(docs.filter("text <> ''"), ["doc_id"]).filter(is_word(F.col("t"))).select("doc_id", normalize_word(F.col("t")).alias("term"), "s")
    return rows.filter((F.length("term") >= 4) & ~F.col("term").isin(STOP_WORDS)).groupBy("doc_id", "term").agg(F.count("*").alias("frequency"), F.min("s").alias("first_start"))


def abbreviations(docs: DataFrame) -> DataFrame:
    """(doc_id, text, short, frequency, s, e, expansion): words of two to ten letters without a small one, where they come
    first, and the text before the bracket that they stand in there, if it is six characters long at least."""
    guard = F.col("text").rlike(r"(?:\p{IsUppercase}[^\p{IsLowercase}\p{IsWhite_Space}]*){2}")
    # All of a document's words are in its row, so they are counted there; each step refers to columns of the one before.
    base = docs.filter(guard).select("doc_id", "text", tokenize(F.col("text")).alias("_toks"))
    base = base.withColumn("_offs", running_sum(F.transform("_toks", lambda t: F.length(t))))
    capital = F.filter(F.arrays_zip("_toks", "_offs"), lambda z: is_word(z["_toks"]) & ~z["_toks"].rlike(r"\p{IsLowercase}"))
    base = base.select("doc_id", "text", F.transform(capital, lambda z: F.struct(F.upper(F.regexp_replace(z["_toks"], r"\P{IsAlphabetic}", "")).alias("short"), z["_offs"].alias("s"), (z["_offs"] + F.length(z["_toks"])).alias("e"))).alias("_all"))
    base = base.withColumn("_held", F.filter("_all", lambda x: F.length(x["short"]).between(2, 10))).drop("_all")
    each = base.select("doc_id", "text", "_held", F.explode_outer(F.array_distinct(F.col("_held.short"))).alias("short")).filter("short is not null")
    each = each.withColumn("_of", F.filter("_held", lambda x: x["short"] == F.col("short")))
    first = F.try_element_at("_of", F.lit(1))
    by = each.select("doc_id", "text", "short", F.size("_of").cast("bigint").alias("frequency"), first["s"].alias("s"), first["e"].alias("e"))
    before = F.left("text", F.col("s"))
    opened = F.contains(before, F.lit("(")) & ~F.contains(F.substring_index(before, "(", -1), F.lit(")"))
    head = before.substr(F.lit(1), F.length(before) - F.length(F.substring_index(before, "(", -1)) - 1)
    context = F.regexp_extract(F.regexp_replace(head, r"\p{IsWhite_Space}+$", ""), r"[^.!?\n]*+\z", 0)
    candidate = F.regexp_replace(F.regexp_replace(F.regexp_replace(context, _TRIM, ""), "^[:;,—-]+|[:;,—-]+$", ""), _TRIM, "")
    return by.withColumn("expansion", F.when(opened & (F.length(candidate) >= 6), candidate))
