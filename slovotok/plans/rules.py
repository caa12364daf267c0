"""The rule table: what a rule is, which rules the library brings, and their selection (planning)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

CAPABILITIES = (
    "tokenization", "regex", "sentence_boundaries", "lexicon", "morphology", "syntax", "word_formation", "semantics", "named_entities", "stress", "benchmark",
)
DEFAULT_CAPABILITIES = CAPABILITIES[:7]
PROFILES = ("default", "strict", "typography_only", "grammar_research")
DOMAINS = ("orthography", "punctuation", "grammar", "typography", "style")
LEVELS = ("basic", "school", "intermediate", "advanced", "expert", "heuristic")
STATUSES = ("implemented", "planned", "research")
SEVERITIES = ("info", "warning", "error")


@dataclass(frozen=True)
class Rule:
    """A row of the rule table."""

    rule_id: str
    kind: str
    domain: str
    level: str
    severity: str
    message: str
    requires: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    status: str = "implemented"
    params: dict = field(default_factory=dict, hash=False)
    suggestion: str | None = None
    explanation: str | None = None
    source_refs: tuple[str, ...] = ()
    valid: tuple[str, ...] = ()
    invalid: tuple[str, ...] = ()

    @property
    def default_safe(self) -> bool:
        risky = {"demo", "experimental", "research", "roadmap", "strict-only"}
        return self.status == "implemented" and self.domain != "style" and self.level not in ("advanced", "expert", "heuristic") and not risky & set(self.tags)


def _pairs(text: str) -> list[str]:
    return [x.strip() for x in text.split(";") if x.strip()]


# Rule ids, levels, severities, requirements, tags and word lists of the rule set.
_UNITS = "кг г мг т м см мм км л мл с мин ч кб мб гб вт квт в а ом процентов".split()
_INFINITIVE = "надо нужно можно нельзя должен должна должно должны хочу хочешь хочет хотим хотите хотят буду будешь будет будем будете будут пора обязан обязана обязаны".split()
_SUBJECTS = "я ты он она оно мы вы они кто что".split()
_T, _R, _L, _M, _S, _W, _B = "tokenization", "regex", "lexicon", "morphology", "syntax", "word_formation", "sentence_boundaries"


def _phrases(rule_id: str, level: str, severity: str, requires: tuple[str, ...], tags: tuple[str, ...], forms: str, kind: str = "phrase_map", message: str = "Устойчивое сочетание пишется иначе.") -> Rule:
    # The forms are their own examples.
    wrong, right = zip(*(x.split("=>") for x in _pairs(forms)))
    return Rule(rule_id, kind, rule_id.split(".")[1], level, severity, message, requires, tags, params={"forms": _pairs(forms)}, valid=tuple(dict.fromkeys(right)), invalid=tuple(wrong))


RULES: tuple[Rule, ...] = (
    Rule("ru.typography.multiple_spaces", "multiple_spaces", "typography", "basic", "warning", "Несколько пробелов подряд.", (_R,), params={"replacement": " "}, valid=("Один пробел.",), invalid=("Два  пробела.",)),
    Rule("ru.punctuation.no_space_before_mark", "no_whitespace_before_punctuation", "punctuation", "basic", "error", "Перед знаком не нужен пробел.", (_T,), params={"punctuation": ",.;:!?"}, valid=("Так, хорошо.",), invalid=("Так , плохо.",)),
    Rule("ru.grammar.repeated_word", "repeated_word", "grammar", "basic", "warning", "Слово повторено.", (_T,), valid=("Дом стоит.",), invalid=("Дом дом стоит.",)),
    Rule("ru.punctuation.sentence_terminal", "missing_sentence_terminal", "punctuation", "basic", "warning", "В конце текста нет знака.", (_B,), params={"replacement": "."}, valid=("Тепло.",), invalid=("Тепло",)),
    Rule("ru.orthography.sentence_initial_capital", "sentence_initial_lowercase", "orthography", "basic", "warning", "Предложение начинается со строчной буквы.", (_B, _T), valid=("Лес шумит.",), invalid=("лес шумит.",)),
    Rule("ru.punctuation.unbalanced_guillemets", "unbalanced_quotes", "punctuation", "basic", "warning", "Кавычка без пары.", (_T,), valid=("«Да».",), invalid=("«Да.",)),
    Rule("ru.punctuation.missing_space_after_mark", "missing_whitespace_after_punctuation", "punctuation", "basic", "error", "После знака нужен пробел.", (_T,), valid=("Да, нет.",), invalid=("Да,нет.",)),
    Rule("ru.punctuation.unpaired_delimiters", "unpaired_delimiters", "punctuation", "basic", "error", "Скобка или кавычка без пары.", (_T,), params={"pairs": ["()", "[]", "{}", "«»"]}, valid=("Да (нет).",), invalid=("Да (нет.",)),
    Rule("ru.typography.space_after_opening_punctuation", "space_after_opening_punctuation", "typography", "basic", "error", "Пробел после открывающего знака.", (_T,), valid=("(да)",), invalid=("( да)",)),
    Rule("ru.typography.space_before_closing_quote", "space_before_closing_quote", "typography", "basic", "error", "Пробел перед закрывающей кавычкой.", (_T,), valid=("«да»",), invalid=("«да »",)),
    Rule("ru.typography.hyphen_instead_of_dash", "hyphen_instead_of_dash", "typography", "basic", "warning", "Вместо дефиса нужно тире.", (_T,), valid=("Дом — крепость.",), invalid=("Дом - крепость.",)),
    Rule("ru.typography.dash_spacing", "dash_spacing", "typography", "basic", "warning", "Тире отделяют пробелами.", (_T,), valid=("Дом — крепость.",), invalid=("Дом—крепость.",)),
    Rule("ru.style.multiple_question_exclamation_marks", "multiple_punctuation", "style", "basic", "warning", "Знак повторён.", (_T,), valid=("Да!",), invalid=("Да!!",)),
    Rule("ru.typography.number_unit_spacing", "number_unit_spacing", "typography", "basic", "warning", "Между числом и единицей нужен пробел.", (_T,), params={"units": _UNITS}, valid=("5 кг",), invalid=("5кг",)),
    Rule("ru.orthography.particle_to_libo_nibud_hyphen", "clitic_hyphen_missing", "orthography", "school", "error", "Частица пишется через дефис.", (_T, _W), params={"group": "indefinite_pronominal"}, valid=("кто-то",), invalid=("кто то",)),
    Rule("ru.orthography.zhe_by_li_separate", "separate_particle_hyphenated", "orthography", "school", "warning", "Частица пишется раздельно.", (_T, _R), params={"particles": ["же", "бы", "ли"]}, valid=("он же",), invalid=("он-же",)),
    Rule("ru.orthography.ne_with_common_verbs", "negated_verb_spacing_basic", "orthography", "school", "error", "Не с глаголом пишется раздельно.", (_T, _M), ("не", "глагол", "morphology-backed-seed")),
    Rule("ru.orthography.pol_hyphen_missing_basic", "pol_compound_hyphen_missing", "orthography", "school", "error", "Пол- пишется через дефис.", (_T, _W), ("spelling", "word-formation", "surface-seed"), valid=("пол-яблока",), invalid=("пол яблока",)),
    Rule("ru.orthography.prefix_final_s_z", "prefix_final_z_s_assimilation", "orthography", "school", "error", "Приставка на з или с.", (_T, _W, _L), ("spelling", "prefix-assimilation", "word-formation"), valid=("рассказать",), invalid=("разсказать",)),
    Rule("ru.orthography.mixed_alphabet_word", "mixed_alphabet_word", "orthography", "basic", "error", "В слове буквы двух алфавитов.", (_T,), valid=("дом",), invalid=("дoм",)),
    Rule("ru.orthography.zhi_shi_cha_shcha_basic", "zhi_shi_cha_shcha", "orthography", "basic", "error", "Гласная после шипящей.", (_T,), params={"exceptions": ["брошюра", "жюри", "парашют"]}, valid=("жизнь",), invalid=("жызнь",)),
    _phrases("ru.orthography.ne_common_confusables", "basic", "error", (_T, _L), (), "незнаю=>не знаю; немогу=>не могу; нехочу=>не хочу; небуду=>не буду; небыл=>не был; небыла=>не была; небыло=>не было; небудет=>не будет", "confusable_tokens"),
    _phrases("ru.style.colloquial_spellings_basic", "basic", "warning", (_T, _L), (), "щас=>сейчас; седня=>сегодня; ваще=>вообще; чо=>что; ничо=>ничего; скока=>сколько", "confusable_tokens"),
    Rule("ru.orthography.tsya_tsya_context_heuristic", "tsya_heuristic", "orthography", "school", "warning", "Возможно, тся или ться.", (_T, _M, _S), params={"infinitive_triggers": _INFINITIVE, "finite_subjects": _SUBJECTS}, valid=("надо учиться",), invalid=("надо учится",)),
    _phrases("ru.orthography.negative_pronoun_preposition_spacing_seed", "school", "error", (_T, _L, _W), ("не_ни", "pronoun", "spacing", "seed"), "ниукого=>ни у кого; неукого=>не у кого; нискем=>ни с кем; нескем=>не с кем; ниочём=>ни о чём; ниочем=>ни о чём; неочем=>не о чем", "confusable_tokens"),
    _phrases("ru.orthography.common_adverbial_phrase_spelling_seed", "school", "warning", (_T, _L), ("common-confusable", "adverbial-expression", "seed"), "вобщем=>в общем; вообщем=>в общем; впринципе=>в принципе; всмысле=>в смысле; наконецто=>наконец-то; помоему=>по-моему; всётаки=>всё-таки; всетаки=>всё-таки; какбудто=>как будто", "confusable_tokens"),
    _phrases("ru.orthography.temporal_preposition_phrase_seed", "school", "warning", (_T, _L, _S, _W), ("derivative-preposition", "phrase-map", "seed"), "в течении дня=>в течение дня; в течении часа=>в течение часа; в течении недели=>в течение недели; в течении месяца=>в течение месяца; в течении года=>в течение года; в продолжении дня=>в продолжение дня; в продолжении часа=>в продолжение часа; в заключении выступления=>в заключение выступления; в заключении доклада=>в заключение доклада"),
    _phrases("ru.orthography.compound_preposition_hyphen_seed", "school", "error", (_T, _L, _S), ("hyphen", "preposition", "seed"), "из за=>из-за; из под=>из-под"),
    _phrases("ru.orthography.koe_indefinite_hyphen_seed", "school", "error", (_T, _L, _S, _W), ("hyphen", "pronoun", "word-formation", "seed"), "кое кто=>кое-кто; кое что=>кое-что; кое где=>кое-где; кое как=>кое-как; кое куда=>кое-куда"),
    Rule("ru.orthography.emphatic_to_particle_hyphen_seed", "clitic_hyphen_missing", "orthography", "school", "warning", "Частица пишется через дефис.", (_T, _W), ("particle", "hyphen", "clitic", "seed"), params={"group": "emphatic_to_pronoun_seed"}),
    Rule("ru.orthography.ka_particle_hyphen_seed", "clitic_hyphen_missing", "orthography", "school", "warning", "Частица пишется через дефис.", (_T, _W), ("particle", "hyphen", "imperative", "clitic", "seed"), params={"group": "imperative_ka_seed"}),
    Rule("ru.punctuation.comma_before_subordinator_basic", "missing_comma_before_subordinator", "punctuation", "heuristic", "warning", "Перед союзом нужна запятая.", (_T, _S), params={"markers": ["что", "чтобы", "если", "когда", "пока", "потому что", "поскольку", "хотя", "который", "которая", "которое", "которые"]}, valid=("Знаю, что он тут.",), invalid=("Знаю что он тут.",)),
    Rule("ru.punctuation.double_comma", "regex", "punctuation", "basic", "error", "Запятая повторена.", (_R,), params={"pattern": r",(?U:\s)*,", "replacement": ","}, valid=("Да, нет.",), invalid=("Да,, нет.",)),
    Rule("ru.punctuation.comma_between_homogeneous_members", "coordination_comma_basic", "punctuation", "school", "warning", "Между однородными членами нужна запятая.", (_T, _S), ("coordination", "punctuation-slot", "strict-only")),
    Rule("ru.punctuation.comma_inside_phraseological_pair", "phraseological_coordination_comma", "punctuation", "school", "warning", "Внутри устойчивой пары запятая не ставится.", (_T, _S), ("coordination", "phraseology"), valid=("ни рыба ни мясо",), invalid=("ни рыба, ни мясо",)),
    Rule("ru.grammar.subject_predicate_agreement_basic", "subject_predicate_agreement_basic", "grammar", "school", "warning", "Подлежащее и сказуемое не согласованы.", (_T, _M, _S)),
    Rule("ru.grammar.numeral_noun_agreement", "numeral_noun_agreement_basic", "grammar", "school", "warning", "Форма при числительном.", (_T, _M, _S)),
    Rule("ru.grammar.verb_government_basic", "verb_government_basic", "grammar", "intermediate", "warning", "Глагол управляет другим падежом.", (_T, _L, _M, _S)),
    Rule("ru.grammar.preposition_nominal_group_government_basic", "preposition_nominal_group_government_basic", "grammar", "school", "warning", "Предлог управляет другим падежом.", (_T, _M, _S)),
    Rule("ru.grammar.numeral_nominal_group_agreement_basic", "numeral_nominal_group_agreement_basic", "grammar", "school", "warning", "Форма группы при числительном.", (_T, _M, _S)),
    Rule("ru.grammar.nominal_group_modifier_agreement_basic", "nominal_group_modifier_agreement_basic", "grammar", "school", "warning", "Определение не согласовано.", (_T, _M, _S)),
    Rule("ru.grammar.compound_numeral_nominal_group_agreement_basic", "compound_numeral_nominal_group_agreement_basic", "grammar", "school", "warning", "Форма при составном числительном.", (_T, _M, _S)),
    Rule("ru.grammar.typed_compound_numeral_nominal_group_agreement_basic", "typed_compound_numeral_nominal_group_agreement_basic", "grammar", "school", "warning", "Форма при составном числительном.", (_T, _M, _S)),
    Rule("ru.grammar.adj_noun_agreement_demo", "adj_noun_agreement_demo", "grammar", "advanced", "warning", "Прилагательное не согласовано.", (_T, _M)),
    Rule("ru.punctuation.introductory_phrase_comma_basic", "introductory_phrase_comma", "punctuation", "heuristic", "warning", "Вводное слово отделяют запятой.", (_T, _B), params={"phrases": ["например", "конечно", "вероятно", "возможно", "во-первых", "во-вторых", "следовательно", "итак", "кстати", "по-видимому", "безусловно"]}, valid=("Конечно, да.",), invalid=("Конечно да.",)),
    Rule("ru.grammar.preposition_government_basic", "preposition_government_basic", "grammar", "school", "warning", "Предлог управляет другим падежом.", (_T, _M, _S)),
    _phrases("ru.grammar.preposition_case_phrase_seed", "school", "warning", (_T, _L, _M, _S), (), "по приезду=>по приезде; по окончанию=>по окончании; по завершению=>по завершении; по истечению=>по истечении; согласно приказа=>согласно приказу; оплата за проезд=>оплата проезда; оплата за обучение=>оплата обучения; скучаю за тобой=>скучаю по тебе"),
    _phrases("ru.grammar.numeral_phrase_seed", "school", "warning", (_T, _L, _M), (), "оба стороны=>обе стороны; оба девушки=>обе девушки; обе мужчины=>оба мужчины; полтора недели=>полторы недели; полтора минуты=>полторы минуты; полторы года=>полтора года; двое девушек=>две девушки; трое девушек=>три девушки"),
    _phrases("ru.style.pleonasm_phrase_seed", "school", "warning", (_T, _L), (), "иметь место быть=>иметь место; большая половина=>большая часть; меньшая половина=>меньшая часть; свободная вакансия=>вакансия; главная суть=>суть; прейскурант цен=>прейскурант; памятный сувенир=>сувенир; первый дебют=>дебют"),
    _phrases("ru.grammar.after_event_po_case_seed", "intermediate", "warning", (_T, _L, _S, _M), ("government", "preposition", "phrase-map", "seed"), "по приезду=>по приезде; по прибытию=>по прибытии; по возвращению=>по возвращении; по окончанию=>по окончании; по завершению=>по завершении"),
    _phrases("ru.grammar.expanded_preposition_government_phrase_seed", "school", "warning", (_T, _L, _S, _M, _W), ("government", "derivative-preposition", "phrase-map", "seed"), "согласно договора=>согласно договору; согласно приказа=>согласно приказу; вопреки прогноза=>вопреки прогнозу; вопреки ожидания=>вопреки ожиданию; благодаря этого=>благодаря этому; ввиду этого обстоятельство=>ввиду этого обстоятельства; вследствие этого обстоятельство=>вследствие этого обстоятельства"),
    _phrases("ru.style.expanded_pleonasm_phrase_seed", "intermediate", "info", (_T, _L, _S), ("style", "pleonasm", "phrase-map"), "главная суть=>суть; основная суть=>суть; памятный сувенир=>сувенир; внутренний интерьер=>интерьер; первый дебют=>дебют; свободная вакансия=>вакансия; предварительный анонс=>анонс; конечный итог=>итог"),
    Rule("ru.style.document_abbreviation_first_mention_seed", "document_abbreviation_expansion", "style", "advanced", "info", "Сокращение не раскрыто при первом упоминании.", (_T, _S), ("document-context", "abbreviation", "strict-only")),
    Rule("ru.style.document_style_consistency_seed", "document_style_consistency", "style", "advanced", "info", "Оформление непоследовательно.", (_T, _S), ("document-context", "style-profile", "strict-only")),
)


#: Examples of rules that take no forms: (silent, fires). Those of dictionary rules use the words of lexicon.demo_lexicon().
EXAMPLES = {
    "ru.orthography.ne_with_common_verbs": ("Я не читаю.", "Я нечитаю."),
    "ru.orthography.emphatic_to_particle_hyphen_seed": ("я-то знаю", "я то знаю"),
    "ru.orthography.ka_particle_hyphen_seed": ("ну-ка", "ну ка"),
    "ru.punctuation.comma_between_homogeneous_members": ("красивая, новая книга", "красивая новая книга"),
    "ru.grammar.subject_predicate_agreement_basic": ("книга упала", "книга упал"),
    "ru.grammar.numeral_noun_agreement": ("пять книг", "пять книги"),
    "ru.grammar.verb_government_basic": ("читаю книгу", "читаю книге"),
    "ru.grammar.preposition_nominal_group_government_basic": ("без новой книги", "без новой книгу"),
    "ru.grammar.numeral_nominal_group_agreement_basic": ("пять новых книг", "пять новых книги"),
    "ru.grammar.nominal_group_modifier_agreement_basic": ("красивая новая книга", "красивая новый книга"),
    "ru.grammar.compound_numeral_nominal_group_agreement_basic": ("двадцать пять книг", "двадцать пять книги"),
    "ru.grammar.typed_compound_numeral_nominal_group_agreement_basic": ("сто двадцать пять книг", "сто двадцать пять книги"),
    "ru.grammar.adj_noun_agreement_demo": ("новая книга", "новый книга"),
    "ru.grammar.preposition_government_basic": ("без книги", "без книгу"),
    "ru.style.document_abbreviation_first_mention_seed": ("Союз писателей города (СПГ) и СПГ.", "Есть СПГ и СПГ."),
    "ru.style.document_style_consistency_seed": ("- раз\n- два", "- раз\n* два"),
}
RULES = tuple(r if r.valid or r.rule_id not in EXAMPLES else replace(r, valid=(EXAMPLES[r.rule_id][0],), invalid=(EXAMPLES[r.rule_id][1],)) for r in RULES)


@dataclass(frozen=True)
class RuleFilter:
    """Which rules to run: excluded ids win; an id that is included by name needs no profile; statuses replace the profile."""

    profile: str = "default"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()

    def _profile(self, r: Rule) -> bool:
        if self.profile == "default":
            return r.default_safe
        if self.profile == "strict":
            return r.status == "implemented"
        if self.profile == "typography_only":
            return r.status == "implemented" and r.domain == "typography"
        if self.profile == "grammar_research":
            return r.domain == "grammar"
        raise ValueError(f"unknown profile {self.profile}")

    def matches(self, r: Rule) -> bool:
        if r.rule_id in self.exclude or self.include and r.rule_id not in self.include:
            return False
        if self.domains and r.domain not in self.domains or self.severities and r.severity not in self.severities:
            return False
        if self.statuses:
            return any((s == "default_safe" and r.default_safe) or s == r.status for s in self.statuses)
        return bool(self.include) or self._profile(r)


@dataclass(frozen=True)
class Plan:
    """The rules to run and the ones left out, with why."""

    rules: tuple[Rule, ...]
    skipped: tuple[tuple[str, str, str], ...]


def plan(rules: Iterable[Rule], chosen: RuleFilter, kinds: Iterable[str], available: Iterable[str] = DEFAULT_CAPABILITIES) -> Plan:
    """Selects rules by filter, registered detector kinds and available capabilities; sorted by id."""
    kinds, available = set(kinds), set(available)
    run, skipped = [], []
    for r in sorted(rules, key=lambda r: r.rule_id):
        if not chosen.matches(r):
            continue
        missing = [c for c in r.requires if c not in available]
        if r.kind not in kinds:
            skipped.append((r.rule_id, "unknown_detector_kind", r.kind))
        elif missing:
            skipped.append((r.rule_id, "missing_capabilities", ",".join(missing)))
        else:
            run.append(r)
    return Plan(tuple(run), tuple(skipped))


def rule_rows(spark: SparkSession, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The rules as a dimension table."""
    rows = [
        (r.rule_id, r.kind, r.domain, r.level, r.severity, r.status, r.message, list(r.requires), list(r.tags), r.default_safe, {k: [v] if isinstance(v, str) else list(v) for k, v in r.params.items()}, r.suggestion, r.explanation, list(r.source_refs))
        for r in rules
    ]
    schema = (
        "rule_id string, kind string, domain string, level string, severity string, status string, message string, requires array<string>, tags array<string>, "
        "default_safe boolean, params map<string, array<string>>, suggestion string, explanation string, source_refs array<string>"
    )
    return spark.createDataFrame(rows, schema)


def with_params(rule: Rule, **params) -> Rule:
    """The rule with other parameters."""
    return replace(rule, params={**rule.params, **params})
