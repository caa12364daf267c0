"""Detectors as column expressions. A detector kind is registered with the level at which it sees a document.

token: one condition per token row (columns t, s, e, p1.., n1..); word: the same over word tokens only; nonspace: over tokens
other than white space; text: an array expression over the whole text. Each gives (start, end, replacement) in characters.
All rules of a level are evaluated in one pass over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slovotok.functions.text import CYRILLIC, has_cyrillic, has_latin, is_number, is_punctuation, is_space, is_word, match_case, matches, normalize_word
from slovotok.plans.rules import Rule

ISSUE = "struct<rule_id:string,s:int,e:int,replacement:string>"


@dataclass(frozen=True)
class Hit:
    """Where a condition holds: the span and the replacement."""

    when: Column
    start: Column
    end: Column
    replacement: Column


@dataclass(frozen=True)
class Detector:
    kind: str
    level: str
    build: Callable[[Rule], list[Hit] | Column]
    capabilities: tuple[str, ...] = ()
    guard: Callable[[Rule], Column] | None = None


REGISTRY: dict[str, Detector] = {}


def register(kind: str, level: str, capabilities: tuple[str, ...] = (), guard: Callable[[Rule], Column] | None = None) -> Callable:
    """Registers a detector kind; a kind can be registered once.

    A guard is a condition on a whole text (columns text, and low in lower case) that every text with a hit meets: texts
    that meet no guard of a level are not cut into tokens."""

    def put(build: Callable) -> Callable:
        if kind in REGISTRY:
            raise ValueError(f"detector kind {kind} is registered already")
        REGISTRY[kind] = Detector(kind, level, build, capabilities, guard)
        return build

    return put


def _map(forms: list[str]) -> dict[str, str]:
    return {a.strip().lower(): b.strip() for a, _, b in (f.partition("=>") for f in forms) if b}


def _lookup(values: dict[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _one_line_space(token: Column) -> Column:
    return is_space(token) & ~F.coalesce(token.contains("\n"), F.lit(False))


def _S() -> Column:  # noqa: N802
    return F.col("s")


def _E() -> Column:  # noqa: N802
    return F.col("e")


def _T() -> Column:  # noqa: N802
    return F.col("t")


def _LOW() -> Column:  # noqa: N802
    return F.col("low")


_W = r"[\p{IsAlphabetic}\-‑–']"


def _any_word(words: list[str]) -> Column:
    """Whether one of the words occurs by itself, also with joiners that normalisation drops."""
    by_first: dict[str, list[str]] = {}
    for w in sorted({w.lower() for w in words if w}):
        by_first.setdefault(w[0], []).append("['‑–]*".join("\\" + c if c == "-" else c for c in w[1:]))
    if not by_first:
        return F.lit(False)
    # Most places are ruled out by the letter before and the first one.
    spelt = "|".join(f"{first}['‑–]*+(?:{'|'.join(rest)})" for first, rest in by_first.items())
    return _LOW().rlike(rf"(?<!\p{{IsAlphabetic}})(?=[{''.join(by_first)}])(?:{spelt})(?!\p{{IsAlphabetic}})")


def _spans(found: Column, rule: Rule, replacement: Callable[[Column], Column], start=lambda x: x["s"], end=lambda x: x["e"]) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(rule.rule_id).alias("rule_id"), start(x).cast("int").alias("s"), end(x).cast("int").alias("e"), replacement(x).cast("string").alias("replacement")))


@register("manual", "text")
def _manual(rule: Rule) -> Column:
    return F.array().cast(f"array<{ISSUE}>")


@register("regex", "text", ("regex",))
def _regex(rule: Rule) -> Column:
    return _spans(matches(F.col("text"), rule.params["pattern"]), rule, lambda x: F.lit(rule.params.get("replacement")))


@register("multiple_spaces", "text", ("regex",))
def _multiple_spaces(rule: Rule) -> Column:
    return _spans(matches(F.col("text"), r"[\p{IsWhite_Space}&&[^\r\n]]{2,}"), rule, lambda x: F.lit(rule.params.get("replacement", " ")))


@register("no_whitespace_before_punctuation", "token", ("tokenization",),
          lambda r: F.col("text").rlike(r"[\p{IsWhite_Space}&&[^\n]][" + "".join("\\" + c for c in r.params["punctuation"]) + "]"))
def _space_before(rule: Rule) -> list[Hit]:
    marks = "".join("\\" + c for c in rule.params["punctuation"])
    return [Hit(_one_line_space(_T()) & is_punctuation(F.col("n1")) & F.col("n1").rlike(f"^[{marks}]+$"), _S(), _E() + F.length("n1"), F.col("n1"))]


@register("missing_whitespace_after_punctuation", "text", ("tokenization",))
def _missing_space(rule: Rule) -> Column:
    # A full stop between digits (with a digit after the next character) or between a letter and a capital is exempt.
    after = r"[\p{IsAlphabetic}\p{N}]"
    pattern = rf"(?:(?<=[,;:!?…]){after}|(?<=\.)(?!(?<=[0-9]\.)[0-9])(?!(?<=\p{{IsAlphabetic}}\.)\p{{IsUppercase}}){after})"
    return _spans(matches(F.col("text"), pattern), rule, lambda x: F.concat(F.lit(" "), x["m"]))


@register("repeated_word", "token", ("tokenization",),
          lambda r: _LOW().rlike(rf"(?<!{_W})({_W}++)\p{{IsWhite_Space}}++\1(?!{_W})"))
def _repeated(rule: Rule) -> list[Hit]:
    same = is_word(_T()) & is_space(F.col("p1")) & is_word(F.col("p2")) & (F.lower("p2") == F.lower(_T()))
    return [Hit(same, _S() - F.length("p1") - F.length("p2"), _E(), _T())]


@register("missing_sentence_terminal", "text", ("sentence_boundaries",))
def _terminal(rule: Rule) -> Column:
    trimmed = F.regexp_replace(F.col("text"), r"\p{IsWhite_Space}+\z", "")
    at = F.length(trimmed)
    one = F.array(F.struct(F.lit(rule.rule_id).alias("rule_id"), at.alias("s"), at.alias("e"), F.lit(rule.params.get("replacement", ".")).alias("replacement")))
    return F.when((at > 0) & ~trimmed.rlike(r"[.!?…]\z"), one).otherwise(F.array().cast(f"array<{ISSUE}>"))


@register("particle_hyphen_missing", "token", ("tokenization",),
          lambda r: _LOW().rlike(rf"\p{{IsWhite_Space}}(?:{'|'.join(x.lower() for x in r.params['particles'])})(?!{_W})"))
def _particle_hyphen(rule: Rule) -> list[Hit]:
    bases, particles = [w.lower() for w in rule.params["bases"]], [w.lower() for w in rule.params["particles"]]
    when = is_word(_T()) & _one_line_space(F.col("n1")) & is_word(F.col("n2")) & F.lower(_T()).isin(bases) & F.lower("n2").isin(particles)
    return [Hit(when, _S(), _E() + F.length("n1") + F.length("n2"), F.concat(_T(), F.lit("-"), F.col("n2")))]


@register("separate_particle_hyphenated", "text", ("regex",))
def _separate_particle(rule: Rule) -> Column:
    found = matches(F.col("text"), r"(?iuU)\b(?:[а-яё]+)-(?:же|бы|ли)\b")
    return _spans(found, rule, lambda x: F.concat(F.substring_index(x["m"], "-", 1), F.lit(" "), F.substring_index(x["m"], "-", -1)))


# The clitics that are written with a hyphen, and the words before them.
CLITICS = {
    "indefinite_pronominal": (
        "кто что чей какой какая какое какие как где куда откуда когда почему зачем сколько так там туда оттуда тогда столько".split(),
        ["то", "либо", "нибудь"],
    ),
    "emphatic_to_pronoun_seed": ("я ты он она оно мы вы они это тот".split(), ["то"]),
    "imperative_ka_seed": ("ну давай давайте скажи скажите глянь гляньте подумай постой постойте поди".split(), ["ка"]),
}


def _clitic_guard(rule: Rule) -> str:
    bases, particles = CLITICS.get(rule.params["group"], ([""], [""]))
    # The first letter rules out most places before anything else is looked at.
    return rf"(?=[{''.join(sorted({b[:1] for b in bases}))}])(?<!{_W})(?:{'|'.join(bases)})\p{{IsWhite_Space}}++(?:{'|'.join(particles)})(?!{_W})"


@register("clitic_hyphen_missing", "token", ("tokenization", "word_formation"),
          lambda r: _LOW().rlike(_clitic_guard(r)))
def _clitic(rule: Rule) -> list[Hit]:
    if rule.params["group"] not in CLITICS:
        raise ValueError(f"unknown clitic group {rule.params['group']} in {rule.rule_id}")
    bases, particles = CLITICS[rule.params["group"]]
    when = is_word(_T()) & _one_line_space(F.col("n1")) & is_word(F.col("n2")) & F.lower(_T()).isin(bases) & F.lower("n2").isin(particles)
    return [Hit(when, _S(), _E() + F.length("n1") + F.length("n2"), F.concat(_T(), F.lit("-"), F.col("n2")))]


# Pairs that take no comma (conjunction, first word, second word).
PAIRED = (
    "и так сяк",
    "и так эдак",
    "и так этак",
    "и день ночь",
    "и стар млад",
    "и смех грех",
    "и смех горе",
    "и холод голод",
    "и туда сюда",
    "ни слуху духу",
    "ни свет заря",
    "ни рыба мясо",
    "ни ответа привета",
    "ни конца края",
    "ни конца краю",
    "ни да нет",
    "ни дать взять",
    "ни себе людям",
    "ни жив мертв",
    "ни взад вперед",
    "ни сном духом",
    "ни пуха пера",
    "ни много мало",
    "ни больше меньше",
    "ни тпру ну",
    "ни встать сесть",
    "ни туда сюда",
)


@register("phraseological_coordination_comma", "nonspace", ("tokenization", "syntax"),
          lambda r: _LOW().rlike(rf"(?:^|\P{{IsAlphabetic}})(?:ни|и)\p{{IsWhite_Space}}++{_W}++\p{{IsWhite_Space}}*+,\p{{IsWhite_Space}}*+(?:ни|и)\p{{IsWhite_Space}}"))
def _paired(rule: Rule) -> list[Hit]:
    triples = ["|".join(x.split()) for x in PAIRED]
    fold = lambda c: F.translate(F.lower(c), "ё", "е")
    same = (F.col("n2") == ",") & (fold("n3") == fold("t"))
    when = same & F.concat_ws("|", fold("t"), fold("n1"), fold("n4")).isin(triples)
    return [Hit(when, F.col("ns2"), F.col("ns2") + F.length("n2"), F.lit(""))]


def _delimiters(rule: Rule, pairs: list[tuple[str, str]], quotes_only: bool) -> Column:
    """Delimiters fold over a stack: a closer takes off the top and reports itself if that is not its opener (for quotes it
    leaves a wrong top in place); what stays on the stack is reported."""
    openers, closers = "".join(o for o, _ in pairs), "".join(c for _, c in pairs)
    cls = "".join("\\" + c for c in openers + closers)
    found = matches(F.col("text"), f"[{cls}]")
    kind = "array<struct<m:string,s:int>>"
    start = F.struct(F.array().cast(kind).alias("stack"), F.array().cast(kind).alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["m"].alias("m"), x["s"].alias("s")))
        depth = F.size(acc["stack"])
        top = F.try_element_at(acc["stack"], F.lit(-1))["m"]
        wanted = F.translate(x["m"], closers, openers)
        good = (depth > 0) & (top == wanted)
        popped = F.slice(acc["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
        opens = x["m"].isin(list(openers))
        return F.struct(
            F.when(opens, F.concat(acc["stack"], one)).when(good, popped).otherwise(acc["stack"] if quotes_only else popped).alias("stack"),
            F.when(~opens & ~F.coalesce(good, F.lit(False)), F.concat(acc["bad"], one)).otherwise(acc["bad"]).alias("bad"),
        )

    folded = F.aggregate(found, start, step, lambda a: F.concat(a["bad"], a["stack"]))
    return _spans(folded, rule, lambda x: F.lit(None), end=lambda x: x["s"] + 1)


@register("unbalanced_quotes", "text", ("tokenization",))
def _quotes(rule: Rule) -> Column:
    return _delimiters(rule, [("«", "»")], True)


@register("unpaired_delimiters", "text", ("tokenization",))
def _unpaired(rule: Rule) -> Column:
    given = ["".join(p.split()) for p in rule.params.get("pairs") or ["()", "[]", "{}", "«»"]]
    return _delimiters(rule, [(p[0], p[1]) for p in given if len(p) > 1], False)


@register("mixed_alphabet_word", "token", ("tokenization",),
          lambda r: has_latin(F.col("text")) & F.col("text").rlike(rf"[A-Za-z]{_W}*{CYRILLIC}|{CYRILLIC}{_W}*[A-Za-z]"))
def _mixed(rule: Rule) -> list[Hit]:
    return [Hit(is_word(_T()) & has_cyrillic(_T()) & has_latin(_T()), _S(), _E(), F.lit(None))]


@register("confusable_tokens", "token", ("tokenization", "lexicon"),
          lambda r: _any_word(list(_map(r.params["forms"]))))
def _confusable(rule: Rule) -> list[Hit]:
    values = _map(rule.params["forms"])
    norm = normalize_word(_T())
    return [Hit(is_word(_T()) & norm.isin(list(values)), _S(), _E(), match_case(_T(), _lookup(values, norm)))]


def _overlap(a: str, b: str) -> bool:
    """Whether two phrases can share letters of a text: one within the other, or the end of one at the start of the other."""
    return a in b or b in a or any(a.endswith(b[:k]) or b.endswith(a[:k]) for k in range(1, min(len(a), len(b))))


@register("phrase_map", "text", ("tokenization", "lexicon"))
def _phrases(rule: Rule) -> Column:
    """Occurrences of each phrase are found left to right without overlap; those inside longer words are then dropped. Phrases
    that cannot overlap are looked for together, others in turn."""
    values, groups = _map(rule.params["forms"]), []
    for bad in values:
        free_group = next((g for g in groups if not any(_overlap(bad, x) for x in g)), None)
        groups.append([bad]) if free_group is None else free_group.append(bad)
    free = lambda x: ~F.coalesce(F.col("text").substr(x["s"], F.lit(1)).rlike(r"\p{IsAlphabetic}") & (x["s"] > 0), F.lit(False)) & ~F.coalesce(F.col("text").substr(x["e"] + 1, F.lit(1)).rlike(r"^\p{IsAlphabetic}"), F.lit(False))
    out = []
    for g in groups:
        found = matches(_LOW(), "(?:" + "|".join(f"\\Q{bad}\\E" for bad in sorted(g, key=len, reverse=True)) + ")")
        spans = _spans(F.filter(found, free), rule, lambda x: _lookup(values, x["m"]))
        some = reduce(lambda a, b: a | b, [_LOW().contains(bad) for bad in g])
        out.append(F.when(some, spans).otherwise(F.array().cast(f"array<{ISSUE}>")))
    return out[0] if len(out) == 1 else F.flatten(F.array(*out))


@register("zhi_shi_cha_shcha", "token", ("tokenization",),
          lambda r: _LOW().rlike("[жш]ы|[чщ][яю]"))
def _zhi_shi(rule: Rule) -> list[Hit]:
    wrong = {"жы": "жи", "шы": "ши", "чя": "ча", "щя": "ща", "чю": "чу", "щю": "щу"}
    fixed = F.lower(_T())
    for a, b in wrong.items():
        fixed = F.replace(fixed, F.lit(a), F.lit(b))
    when = is_word(_T()) & F.lower(_T()).rlike("жы|шы|чя|щя|чю|щю") & ~normalize_word(_T()).isin([x.lower() for x in rule.params.get("exceptions", [])] or [""])
    return [Hit(when, _S(), _E(), match_case(_T(), fixed))]


@register("tsya_heuristic", "word", ("tokenization", "morphology", "syntax"),
          lambda r: _LOW().rlike("т['‑–]*ь?['‑–]*с['‑–]*я") & _any_word([*r.params["infinitive_triggers"], *r.params["finite_subjects"]]))
def _tsya(rule: Rule) -> list[Hit]:
    before, norm = normalize_word(F.col("p1")), normalize_word(_T())
    cut = lambda n, end: F.concat(F.left(_T(), F.greatest(F.length(_T()) - n, F.lit(0))), F.lit(end))
    to_inf = before.isin([x.lower() for x in rule.params["infinitive_triggers"]]) & norm.endswith("тся")
    to_fin = before.isin([x.lower() for x in rule.params["finite_subjects"]]) & norm.endswith("ться")
    changed = lambda n, suffix, end: F.when(F.lower(_T()).endswith(suffix), cut(n, end)).otherwise(_T())
    return [Hit(to_inf | to_fin, _S(), _E(), F.when(to_inf, changed(3, "тся", "ться")).otherwise(changed(4, "ться", "тся")))]


@register("space_after_opening_punctuation", "text", ("tokenization",))
def _after_opening(rule: Rule) -> Column:
    return _spans(matches(F.col("text"), r"(?<=[(\[{«])[ \t]"), rule, lambda x: F.lit(""))


@register("space_before_closing_quote", "text", ("tokenization",))
def _before_closing(rule: Rule) -> Column:
    return _spans(matches(F.col("text"), r"[ \t](?=»)"), rule, lambda x: F.lit(""))


@register("hyphen_instead_of_dash", "text", ("tokenization",))
def _hyphen(rule: Rule) -> Column:
    return _spans(matches(F.col("text"), " - "), rule, lambda x: F.lit(" — "))


@register("dash_spacing", "text", ("tokenization",))
def _dash(rule: Rule) -> Column:
    return _spans(matches(F.col("text"), r"(?:(?<!\p{IsWhite_Space})—|—(?!\p{IsWhite_Space}))"), rule, lambda x: F.lit(" — "))


@register("multiple_punctuation", "text", ("tokenization",))
def _many_marks(rule: Rule) -> Column:
    return _spans(matches(F.col("text"), r"(?:!{2,}|\?{2,})"), rule, lambda x: F.left(x["m"], F.lit(1)))


@register("number_unit_spacing", "token", ("tokenization",),
          lambda r: F.col("text").rlike(r"[0-9０-９][\p{IsAlphabetic}\-‑–']"))
def _unit(rule: Rule) -> list[Hit]:
    when = is_number(_T()) & is_word(F.col("n1")) & normalize_word(F.col("n1")).isin([u.lower() for u in rule.params["units"]])
    return [Hit(when, _E(), _E() + F.length("n1"), F.concat(F.lit(" "), F.col("n1")))]


@register("pol_compound_hyphen_missing", "token", ("tokenization", "word_formation"),
          lambda r: _LOW().rlike(rf"(?=пол)(?<!{_W})пол\p{{IsWhite_Space}}"))
def _pol(rule: Rule) -> list[Hit]:
    when = is_word(_T()) & (F.lower(_T()) == "пол") & _one_line_space(F.col("n1")) & is_word(F.col("n2")) & F.col("n2").rlike(r"^(?:\p{IsUppercase}|(?iu)[аеёиоуыэюял])")
    return [Hit(when, _S(), _E() + F.length("n1") + F.length("n2"), F.concat(_T(), F.lit("-"), F.col("n2")))]


# Prefixes that end in з before voiced and in с before voiceless consonants.
ALTERNATING = "через чрез без воз из низ раз роз вз".split()
VOICELESS, VOICED_OR_VOWEL = "кпстфхцчшщ", "бвгджзйлмнраеёиоуыэюя"


def _roots(rule: Rule) -> str:
    from slovotok.operators.word_formation import ROOTS

    return "(?:" + "|".join(sorted({r for r in rule.params.get("roots", ROOTS) if len(r) > 1}, key=len, reverse=True)) + ")"


def _prefix_guard(rule: Rule) -> str:
    voiceless = "|".join(ALTERNATING)
    voiced = "|".join(z[:-1] + "с" for z in ALTERNATING)
    firsts = "".join(sorted({z[0] for z in ALTERNATING}))
    return rf"(?=[{firsts}])(?<!{_W})(?:(?:{voiceless})(?=[{VOICELESS}])|(?:{voiced})(?=[{VOICED_OR_VOWEL}])){_roots(rule)}"


@register("prefix_final_z_s_assimilation", "token", ("tokenization", "word_formation", "lexicon"),
          lambda r: _LOW().rlike(_prefix_guard(r)))
def _prefix(rule: Rule) -> list[Hit]:
    """The rest of the word must begin with a known root of two letters at least: `roots` of the rule, else the seed roots."""
    start = _roots(rule)
    lower, fixed = F.lower(_T()), None
    for z in ALTERNATING:
        s = z[:-1] + "с"
        for wrong, right, after in ((z, s, VOICELESS), (s, z, VOICED_OR_VOWEL)):
            hit = lower.rlike(f"^{wrong}(?=[{after}]){start}")
            value = F.concat(F.lit(right), F.substring(lower, len(wrong) + 1, 1 << 30))
            fixed = F.when(hit, value) if fixed is None else fixed.when(hit, value)
    return [Hit(is_word(_T()) & fixed.isNotNull(), _S(), _E(), match_case(_T(), fixed))]


@register("sentence_initial_lowercase", "fold", ("sentence_boundaries", "tokenization"))
def _initial(rule: Rule) -> list[Hit]:
    """Built by sentences.fold_issues."""
    return []


@register("missing_comma_before_subordinator", "fold", ("tokenization", "syntax"))
def _subordinator(rule: Rule) -> list[Hit]:
    """Built by sentences.fold_issues."""
    return []


@register("introductory_phrase_comma", "fold", ("tokenization", "sentence_boundaries"))
def _introductory(rule: Rule) -> list[Hit]:
    """Built by sentences.fold_issues."""
    return []


def _needs_lexicon(rule: Rule) -> list[Hit]:
    """Built by agreement.with_lexicon."""
    return []


#: Kinds that look at words and their readings only, not at groups, islands or clauses.
_WORDS_ONLY = ("adj_noun_agreement_demo", "negated_verb_spacing_basic")

for _kind in (
    "adj_noun_agreement_demo", "nominal_group_modifier_agreement_basic", "subject_predicate_agreement_basic", "preposition_government_basic", "preposition_nominal_group_government_basic", "numeral_noun_agreement_basic",
    "numeral_nominal_group_agreement_basic", "compound_numeral_nominal_group_agreement_basic", "typed_compound_numeral_nominal_group_agreement_basic", "verb_government_basic", "coordination_comma_basic", "negated_verb_spacing_basic",
):
    register(_kind, "lexicon", ("tokenization", "syntax") if _kind == "coordination_comma_basic" else ("tokenization", "morphology") if _kind in _WORDS_ONLY else ("tokenization", "morphology", "syntax"))(_needs_lexicon)


@register("document_style_consistency", "document", ("tokenization", "syntax"))
def _style(rule: Rule) -> list[Hit]:
    """Built by checking.document_issues."""
    return []


@register("document_abbreviation_expansion", "document", ("tokenization", "syntax"))
def _abbreviation(rule: Rule) -> list[Hit]:
    """Built by checking.document_issues."""
    return []
