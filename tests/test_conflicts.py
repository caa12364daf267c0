import random

from slovotok.operators import agreement, conflicts
from slovotok.operators.disambiguation import TAGS, prune
from slovotok.operators.sentences import first_word
from slovotok.sources.lexicon import read_project
from test_agreement import LEXICON

TEXTS = ["Пять дом. Соседка вчера ушёл, к дом", "новая высокий дом. Пять новых дом", ",-дом ушла. К\nдом", "Соседка (новая дом) ушёл", "", None]


def test_words_are_not_shuffled_and_both_ways_agree(spark):
    lexicon = read_project(spark.createDataFrame([(x,) for x in LEXICON.split("\n")], "value string"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    surfaces = agreement.known_surfaces(docs, lexicon)
    plan = agreement._found(docs, surfaces, None, True, 1 << 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    sent, joined = (sorted(map(str, agreement.conflicts(docs, lexicon, None, True, most).collect())) for most in (1 << 20, -1))
    assert sent == joined and len(sent) > 5


def test_states_lose_the_readings_that_prune_removes():
    draw = random.Random(7)
    kinds = [("preposition",), ("noun", "adjective"), ("noun", "verb"), ("adjective",), ("noun",), ("verb", "predicative", "pronoun")]
    values = {"case": ("nominative", "genitive", ""), "number": ("singular", "plural"), "gender": ("masculine", "feminine", ""), "tense": ("past", ""), "person": ("third", "first", "")}

    def reading(pos):
        return conflicts.FIELD.join({"pos": pos}.get(f, draw.choice(values.get(f, ("",)))) for f in conflicts.FIELDS)

    for _ in range(400):
        n = draw.randint(1, 7)
        words, linked = [draw.choice(("из", "к", "дом", "new")) for _ in range(n)], [*(draw.random() < 0.8 for _ in range(n - 1)), False]
        tags = [conflicts.READING.join(reading(p) for p in draw.choice(kinds) for _ in range(draw.randint(1, 3))) if draw.random() < 0.9 else None for _ in range(n)]
        states = [conflicts.state(t, w) for t, w in zip(tags, words, strict=True)]
        readings = [[dict(r) for r in s.readings] for s in states]
        prune(words, linked, readings)
        conflicts.disambiguate(linked, states)
        assert [[r["at"] for r in s.readings] for s in states] == [[r["at"] for r in x] for x in readings]
    assert set(TAGS) < set(conflicts.FIELDS)


def test_words_begin_after_marks():
    assert conflicts.cut(",-дом слово- и –дом")[0] == ["дом", "слово-", "и", "–дом"]
    assert conflicts.cut("а\u00a0б\nв, г")[2] == [True, False, False, False]
    assert first_word("Слово-. -дом", 7) == (8, "-дом") and first_word("...-дом", 3) == (4, "дом")
