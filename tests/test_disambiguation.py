from slovotok.operators.disambiguation import prune

FIELDS = ("lemma", "pos", "case", "number", "gender", "tense", "person", "adjective_form", "degree", "verb_form")


def r(pos, **kw):
    return {**dict.fromkeys(FIELDS), "pos": pos, **kw}


NOUN = {"number": "singular", "gender": "feminine"}
FROM = r("preposition")
STEEL, BECAME = r("noun", case="genitive", **NOUN), r("verb", number="plural", tense="past")


def run(words, linked, readings):
    left = [list(x) for x in readings]
    gone = prune(words, linked, left)
    return left, [why for _, _, why, _ in gone]


def test_prepositions():
    left, why = run(["Из", "пилы"], [True, False], [[FROM], [STEEL, BECAME, r("noun", case="nominative", number="plural")]])
    assert left[1] == [STEEL] and sorted(why) == ["preposition_case_government", "preposition_verb_exclusion"]
    assert run(["Из", "пилы"], [False, False], [[FROM], [STEEL, BECAME]])[1] == []
    assert run(["Из", "пилы"], [True, False], [[FROM], [BECAME]])[1] == []


def test_modifier_and_head():
    new = r("adjective", case="nominative", number="plural")
    houses = [r("noun", case="nominative", number="plural"), r("noun", case="genitive", number="singular", gender="masculine")]
    left, why = run(["новые", "дома"], [True, False], [[new], houses])
    assert left[1] == houses[:1] and why == ["modifier_head_agreement"]
    wrong = r("adjective", case="dative", number="plural")
    assert run(["новым", "дома"], [True, False], [[wrong], houses])[1] == []


def test_subject_and_predicate():
    she = r("noun", case="nominative", **NOUN)
    came, bake = r("verb", number="singular", tense="past", gender="feminine"), r("noun", case="accusative", **NOUN)
    left, why = run(["Соседка", "пришла"], [True, False], [[she], [came, bake]])
    assert left[1] == [came] and why == ["subject_predicate_agreement"]
    assert run(["Вот", "соседка", "пришла"], [True, True, False], [[], [she], [came, bake]])[1] == []


def test_documents_in_small_batches():
    import pyarrow as pa

    from slovotok.operators.disambiguation import documents_of

    for ids in ([1, 1, 2, 2, 2, 3], [1] * 7, [1, 2, 3], [None, None, 2, 2, 2, 2, 2, 5, 5]):
        for size in (1, 2, 3, 10):
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "n": range(len(ids))})
            parts = [p.to_pydict() for p in documents_of(iter(table.to_batches(max_chunksize=size)))]
            assert [x for p in parts for x in p["n"]] == list(range(len(ids)))
            firsts = [set(p["doc_id"]) for p in parts]
            assert sum(map(len, firsts)) == len(set(ids)), "a document is never divided"
            assert max(len(p["n"]) for p in parts) <= size + max(ids.count(x) for x in ids)


def test_words_stay_in_order_when_tags_are_broadcast(spark):
    from pyspark.sql import functions as F

    from slovotok.operators.agreement import word_readings
    from slovotok.operators.disambiguation import disambiguated, eliminations, tagged
    from slovotok.sources.lexicon import read_project

    lines = ["из\tиз\tPREP\t", "пилы\tпила\tNOUN\tfemn|sing|gen", "пилы\tпила\tNOUN\tfemn|plur|nom", "пилы\tпить\tVERB\tpast|plur"]
    lexicon = read_project(spark.createDataFrame([(x,) for x in lines], "value string"))
    docs = spark.createDataFrame([(i, "Вот из пилы. " * (1 + i % 4) + "Пилы") for i in range(40)], "doc_id int, text string").repartition(3)
    words, surfaces = word_readings(docs, lexicon)
    tags = tagged(surfaces)
    gone = [sorted(map(tuple, eliminations(words, tags, small).collect())) for small in (True, False)]
    assert gone[0] == gone[1] and len(gone[0]) == 2 * sum(1 + i % 4 for i in range(40))
    kept = [sorted((r["doc_id"], r["idx"], r["kept"]) for r in disambiguated(words, tags, small).filter(F.col("kept").isNotNull()).collect()) for small in (True, False)]
    assert kept[0] == kept[1] and len(kept[0]) == sum(1 + i % 4 for i in range(40)) and all(len(k) == 1 for _, _, k in kept[0])
