"""Visually identical text in one consistent form, by DuckDB expressions inside Arrow partitions.

Compatibility forms (full-width and small forms, styled letters, ligatures) become plain characters; invisible characters
go; spaces and hyphens become the plain ones; each run of letters is written in one script: Cyrillic if it holds a letter
that only Cyrillic has, else Latin if it holds one that only Latin has, else (all letters look alike in both) Cyrillic,
unless the text has Latin letters of its own and no Cyrillic ones; then letters and their accents are composed (NFC).
Signs such as the numero sign, ellipsis, superscripts, guillemets and dashes, stress marks, case, repeated spaces and
spelling stay.

Defined results: null stays null, the empty text stays empty; texts of any length are handled whole, one batch at a time;
repeated rows each give a result; all other columns pass unchanged, also ones named like internal ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look alike, position by position.
LATIN_ALIKE = "aceopxyijshABCEHKMOPTXYIJS"
CYRILLIC_ALIKE = "асеорхуіјѕһАВСЕНКМОРТХУІЈЅ"
GREEK_ALIKE = "ΑΒΕΗΚΜΟΡΤΧΥΙονα"
GREEK_AS_LATIN = "ABEHKMOPTXYIova"
GREEK_AS_CYRILLIC = "АВЕНКМОРТХУІоѵа"
# Latin small capitals: as small Latin and as small Cyrillic letters.
SMALL_CAPITALS = "ᴀʙᴄᴇɢʜɪᴊᴋᴍɴᴏᴘᴛᴠᴡᴢ"
SMALL_CAPITALS_AS_LATIN = "abceghijkmnoptvwz"
SMALL_CAPITALS_AS_CYRILLIC = "авсеԍніјкмпортѵшз"
# Letters of other alphabets that are read as Latin or Cyrillic only inside a word of that script: Greek, Armenian, Cherokee.
OTHER_ALIKE = "ρχκօՕᎪᏴᏟᎬᎻᎫᏦᎷᏢᎢᏚ"
OTHER_AS_LATIN = "pxkoOABCEHJKMPTS"
OTHER_AS_CYRILLIC = "рхкоОАВСЕНЈКМРТЅ"
# Letters of the Russian alphabet that Latin has too; i, j, s and h have no Russian look-alike.
SHARED_LATIN = "aceopxyABCEHKMOPTXY"
SHARED_CYRILLIC = "асеорхуАВСЕНКМОРТХУ"

#: Characters that Unicode ignores by default when text is shown: soft hyphens, joiners, fillers, directions, selectors, tags.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
             (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
#: Characters that are consistent by themselves: ASCII, Russian letters, and common marks.
ORDINARY = r"\x09\x0A\x0D\x20-\x7EА-яЁё«»—–…№"
SPACES = "               　"
HYPHENS = "‐‑‒⁃−﹣－"


#: Bytes of text that DuckDB is given at once.
PART_BYTES = 8 << 20


def _compatibility() -> dict[str, str]:
    """Full-width, small and styled characters with their plain ones, derived from the Unicode data."""
    ranges = [(0xFF01, 0xFF5E), (0xFFE0, 0xFFE6), (0xFE50, 0xFE6B), (0x1D400, 0x1D7FF)]
    plain = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in ranges for c in range(a, b + 1)}
    return {k: v for k, v in plain.items() if len(v) == 1 and v != k}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(sql: str, table: dict[str, str]) -> str:
    return f"translate({sql}, {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"


def _accented(base: str, as_base: str) -> dict[str, str]:
    """Composed letters on a base that looks like another script's: the same accent on the other base, decomposed."""
    out = {}
    for c in map(chr, range(0xC0, 0x250)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0] in base:
            out[c] = as_base[base.index(parts[0])] + parts[1]
    return out


def _russian(accented: dict[str, str]) -> str:
    """Those that stand for a letter of the Russian alphabet or a stressed vowel; all others are letters that only Latin has."""
    return "".join(c for c, v in accented.items() if v[1] in "\u0301\u0300" or unicodedata.normalize("NFC", v) in "ёйЁЙ")


def _chain(sql: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        sql = f"replace({sql}, {_quoted(a)}, {_quoted(b)})"
    return sql


def form_parts(column: str) -> tuple[str, str, str]:
    """SQL: the text `t` in plain characters; whether `t` is Latin text; the consistent form of `t`."""
    single = {**_compatibility(), **dict.fromkeys(SPACES, " "), **dict.fromkeys(HYPHENS, "-")}
    invisible = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in INVISIBLE)
    text = _translate(f"regexp_replace({column}, '[{invisible}]', '', 'g')", single)
    text = _chain(text, {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xFB00, 0xFB07))})
    # Most texts hold ordinary characters only, which stay and are composed already.
    ordinary = lambda c: f"regexp_full_match({c}, '[{ORDINARY}]*')"
    text = f"case when {ordinary(column)} then {column} else {text} end"
    accented = _accented(SHARED_LATIN, SHARED_CYRILLIC)
    only_cyrillic = f"[^\\P{{Cyrillic}}{CYRILLIC_ALIKE}]"
    only_latin = f"[^\\P{{Latin}}{SHARED_LATIN}{SMALL_CAPITALS}{_russian(accented)}]"
    to_cyrillic = dict(zip(SHARED_LATIN + GREEK_ALIKE + SMALL_CAPITALS, SHARED_CYRILLIC + GREEK_AS_CYRILLIC + SMALL_CAPITALS_AS_CYRILLIC, strict=True))
    to_latin = dict(zip(CYRILLIC_ALIKE + GREEK_ALIKE + SMALL_CAPITALS, LATIN_ALIKE + GREEK_AS_LATIN + SMALL_CAPITALS_AS_LATIN, strict=True))
    others = dict(zip(OTHER_ALIKE, OTHER_AS_CYRILLIC, strict=True)), dict(zip(OTHER_ALIKE, OTHER_AS_LATIN, strict=True))
    mixed = SHARED_LATIN + GREEK_ALIKE + SMALL_CAPITALS + "".join(accented)

    def as_cyrillic(table: dict[str, str], found: str) -> str:
        return f"case when regexp_matches(w, '[{found}]') then {_translate(_chain('w', accented), table)} else w end"

    def as_latin(table: dict[str, str]) -> str:
        return f"case when regexp_matches(w, '[{''.join(table)}]') then {_translate('w', table)} else w end"

    latin_text = f"regexp_matches(t, '{only_latin}') and not regexp_matches(t, '{only_cyrillic}')"
    word = (
        f"case when not regexp_matches(w, '^\\pL') then w when regexp_matches(w, '{only_cyrillic}') then {as_cyrillic(to_cyrillic | others[0], mixed + OTHER_ALIKE)} "
        f"when regexp_matches(w, '{only_latin}') then {as_latin(to_latin | others[1])} when regexp_matches(w, '^[{GREEK_ALIKE}]*\\p{{Greek}}') and regexp_matches(w, '[^{GREEK_ALIKE}{SHARED_LATIN}{SHARED_CYRILLIC}\\pM]') then w "
        f"when latin_text then {as_latin(to_latin)} else {as_cyrillic(to_cyrillic, mixed)} end"
    )
    words = f"array_to_string(list_transform(regexp_extract_all(t, '(?:\\pL[\\pL\\pM]*|[^\\pL]+)'), lambda w: {word}), '')"
    # Without a letter of another alphabet there is nothing to decide by word.
    return text, latin_text, f"case when regexp_matches(t, '[\\p{{Latin}}\\p{{Greek}}{OTHER_ALIKE}]') then nfc_normalize({words}) when {ordinary('t')} then t else nfc_normalize(t) end"


def form_query(source: str) -> str:
    """The query over a relation of (i, t0): texts in their consistent form, in order."""
    text, latin_text, form = form_parts("t0")
    return f"select {form} as form from (select i, t, {latin_text} as latin_text from (select i, {text} as t from {source})) order by i"


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about PART_BYTES, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PART_BYTES, prepend=0)) if len(sizes) else []
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if b > a:
            yield texts.slice(a, b - a)


def with_forms(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds, for each text column (key), a column (value) with its consistent form. No shuffle; rows stay where they are."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, *(StructField(n, StringType()) for n in columns.values())])
    names = df.columns
    at = {names.index(c): n for c, n in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # No folder for temporary files: texts go through in parts that fit.
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        query = form_query("texts")
        for batch in batches:
            made: dict[int, list[pa.Array]] = {i: [] for i in at}
            for i in at:
                column = batch.column(i).cast(pa.string())
                for part in _parts(column):
                    con.register("texts", pa.table({"i": pa.array(range(len(part)), pa.int64()), "t0": part}))
                    made[i] += [c.cast(pa.string()) for c in con.sql(query).to_arrow_table().column(0).chunks]
                    con.unregister("texts")
            arrays = [*batch.columns, *(pa.concat_arrays(c) if c else pa.array([], pa.string()) for c in made.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *at.values()])
        con.close()

    return df.mapInArrow(run, schema)


def differing(df: DataFrame, key: str, fields: list[str], tbl: str) -> DataFrame:
    """(tbl, row_no, field) of each value that differs from its consistent form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    values = df.select(F.col(key).alias("row_no"), pairs.alias("x")).select("row_no", "x.field", "x.value").filter(F.col("value").isNotNull())
    formed = with_forms(values, {"value": "form"})
    return formed.filter(F.col("value") != F.col("form")).select(F.lit(tbl).alias("tbl"), "row_no", "field")
