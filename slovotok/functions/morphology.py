"""Morphological tags: parts of speech, categories and grammemes from tags of several tag sets."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of speech with the tags that mean them.
_POS = """noun: noun n s сущ substantive
adjective: adj adjf adjs adjective a полн_прил кратк_прил прил
verb: verb infn v гл
participle: participle part prtf prts прич
gerund: gerund grnd деепр
pronoun: pron npro pronoun мест
numeral: num numr numeral числ
adverb: adv advb adverb нар
comparative: comp comparative сравн
predicative: pred predicative предик
preposition: prep preposition предл
conjunction: conj conjunction союз
particle: partcl prcl particle част
interjection: intj interjection межд
punctuation: punct punctuation"""
# The categories in the order in which a bare tag is tried, with their values and the tags that mean them.
_CATEGORIES = """case: nominative=nom nomn nominative имен; genitive=gen gent genitive род; dative=dat datv dative дат; accusative=acc accs accusative вин; instrumental=ins ablt inst instrumental твор; prepositional=prep loct prepositional предл; locative=loc loc2 locative местн; partitive=part gen2 partitive парт; vocative=voct voc vocative зв
number: singular=sing sg singular ед; plural=plur pl plural мн
gender: masculine=masc m masculine муж; feminine=fem femn f feminine жен; neuter=neut n neutral neuter сред; common=common ms_f общ
animacy: animate=anim animate од; inanimate=inan inanimate неод
aspect: perfective=perf perfective сов; imperfective=impf imperf imperfective несов
tense: past=past pst прош; present=pres present наст; future=futr future буд
person: first=1 1p 1per first; second=2 2p 2per second; third=3 3p 3per third
adjective_form: full=full plen adjf полн; short=short brev adjs кратк
degree: positive=pos positive; comparative=comp comparative cmp сравн; superlative=supr superlative sup прев
verb_form: infinitive=inf infn infinitive инф; finite=finite fin личн; participle=part participle prtf prts прич; gerund=gerund grnd деепр
mood: indicative=ind indicative изъяв; imperative=imp impr imperative повел
voice: active=act actv active действ; passive=pass pssv passive страд
grammeme: proper_name=proper proper_name name имя propn; common_noun=common common_noun; qualitative=qual qualitative кач; relative=rel relative относ; possessive=poss possessive притяж; ordinal=ordinal ord порядк; cardinal=cardinal card колич; collective=collective coll собират; transitive=trans tran переход; intransitive=intr intransitive непереход; reflexive=reflexive refl возвр; impersonal=impersonal imprs безл; indeclinable=indecl indeclinable 0; abbreviation=abbr abbreviation сокр"""
_KEYS = {"number": ("number", "num"), "adjective_form": ("adj_form", "adjective_form", "form")}
CATEGORIES = tuple(line.partition(":")[0] for line in _CATEGORIES.splitlines())[:-1]


@lru_cache(maxsize=1)
def pos_tags() -> dict[str, str]:
    """Tag to part of speech."""
    return {tag: pos for pos, _, tags in (line.partition(":") for line in _POS.splitlines()) for tag in tags.split()}


@lru_cache(maxsize=1)
def tag_meanings() -> dict[str, str]:
    """Normalised tag, bare or key=value, to category=value; a bare tag means the first category that knows it."""
    bare: dict[str, str] = {}
    keyed: dict[str, str] = {}
    for line in _CATEGORIES.splitlines():
        category, _, values = line.partition(":")
        for value, _, tags in (v.strip().partition("=") for v in values.split(";")):
            for tag in tags.split():
                bare.setdefault(tag, f"{category}={value}")
                if category != "grammeme":
                    for key in _KEYS.get(category, (category,)):
                        keyed[f"{key}={tag}"] = f"{category}={value}"
    return bare | keyed


def normalize_tag(tag: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(F.trim(tag), "^@+", "")), F.lit("-"), F.lit("_"))


def _literal_map(values: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(v) for v in values.values()]))


def part_of_speech(tag: Column) -> Column:
    """The part of speech that a tag means; other if none."""
    return F.coalesce(F.try_element_at(_literal_map(pos_tags()), normalize_tag(tag)), F.lit("other"))


def first_part_of_speech(tags: Column) -> Column:
    """The first part of speech among tags; other if there is none."""
    known = F.filter(F.transform(tags, part_of_speech), lambda p: p != "other")
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("other"))


def split_tags(text: Column) -> Column:
    """Tags joined by | , or white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[|,\p{IsWhite_Space}]"), lambda t: t != "")


def project_tags(text: Column) -> Column:
    """Tags joined by | only, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda t: F.trim(t)), lambda t: t != "")


def features(tags: Column) -> dict[str, Column]:
    """Columns of the categories (null where no tag gives one; the last one counts), grammemes, raw_tags and unrecognized_tags."""
    meanings = F.transform(tags, lambda t: F.try_element_at(_literal_map(tag_meanings()), normalize_tag(t)))

    def of(category: str) -> Column:
        found = F.filter(meanings, lambda m: m.startswith(category + "="))
        return F.substring_index(F.try_element_at(found, F.lit(-1)), "=", -1)

    out = {c: of(c) for c in CATEGORIES}
    grammemes = F.transform(F.filter(meanings, lambda m: m.startswith("grammeme=")), lambda m: F.substring_index(m, "=", -1))
    known = lambda t: F.try_element_at(_literal_map(tag_meanings()), normalize_tag(t)).isNull()
    out["grammemes"] = F.array_sort(F.array_distinct(grammemes))
    out["raw_tags"] = F.array_sort(F.array_distinct(tags))
    out["unrecognized_tags"] = F.array_sort(F.array_distinct(F.filter(tags, known)))
    return out


# The cases that prepositions govern.
PREPOSITIONS = """genitive: без для до из от у около вокруг после против ради кроме среди возле из-за из-под
dative: к согласно благодаря вопреки
prepositional accusative: о об в во на
prepositional: при
instrumental: между над перед
instrumental accusative: под за
genitive accusative instrumental: с со
dative accusative prepositional: по
accusative: через про"""


@lru_cache(maxsize=1)
def preposition_cases() -> dict[str, tuple[str, ...]]:
    """Preposition to the cases it governs."""
    rows = (line.partition(":") for line in PREPOSITIONS.splitlines())
    return {word: tuple(cases.split()) for cases, _, words in rows for word in words.split()}
