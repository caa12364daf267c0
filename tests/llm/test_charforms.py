import random
import unicodedata

from slovotok.llm import charforms

LATIN, CYRILLIC = charforms.SHARED_LATIN, charforms.SHARED_CYRILLIC


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "z", "z") for i, t in enumerate(texts)], "i int, t0 string, form string, w string")
    return [r["made"] for r in charforms.with_forms(df, {"t0": "made"}).orderBy("i").collect()]


def test_cases(spark):
    cases = {
        "Чacть пoявлялаcь": "Часть появлялась", "K счастью PDF-фaйл НTML": "К счастью PDF-файл HTML", "й ё далëкой": "й ё далёкой", "Βο-первых": "Во-первых",
        "С Х　У": "С Х У", "１２，да！": "12,да!", "т​е\xadст": "тест", "по‑новому －": "по-новому -", "Unicodе": "Unicode",
    }
    assert forms(spark, list(cases)) == list(cases.values())


def test_content_stays(spark):
    texts = ["о́стров, бо́льшой", "№ … ² « » — –", "е и ё", "ВСЁ  два пробела", "ашибка", "", None, "Wi-Fi и HTML", "crème brûlée", "ΑΒΓ αβγ", "что?\nда\tнет"]
    assert forms(spark, texts) == texts


def test_other_scripts_and_signs(spark):
    cases = {
        "ㅤтекстﾠ": "текст", "сло\U000e0061во\U000e0100": "слово", "ʜᴏᴡый": "нош" + "ый", "ᴛᴇxᴛ file": "text file", "хρам": "храм", "Ꮋовый": "Новый", "wօrd": "word",
        "Å": "Å", "Ångström и Ä": "Ångström и Ä", "\u212b": "Å", "ρ = 5 и χ": "ρ = 5 и χ", "օհ": "օհ", "pё": "рё", "cáxap": "са́хар",
    }
    assert forms(spark, list(cases)) == list(cases.values())


def test_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(charforms, "PART_BYTES", 50)
    texts = ["тeкст" * n if n % 5 else None for n in range(40)] + ["", "x" * 100, ""]
    import pyarrow as pa

    column = pa.array(texts, pa.string())
    parts = list(charforms._parts(column))
    assert pa.concat_arrays(parts).to_pylist() == texts and len(parts) > 5 and list(charforms._parts(column[:0])) == []


def test_disguise_comes_off(spark):
    rng = random.Random(5)
    words = "Возможно полезный редактор напечатал ещё короткий указатель объяснения чёрный йод PDF Unicode HTML".split()
    clean, spoilt = [], []
    for _ in range(200):
        text = " ".join(rng.choices(words, k=6))
        out = []
        for c in text:
            if c in CYRILLIC and rng.random() < 0.2:
                c = LATIN[CYRILLIC.index(c)]
            elif c in "йё" and rng.random() < 0.3:
                c = unicodedata.normalize("NFD", c)
            elif c == " " and rng.random() < 0.3:
                c = rng.choice(charforms.SPACES.replace(" ", "") or "\xa0")
            out.append(c + (rng.choice("​‍⁠﻿\xad") if rng.random() < 0.1 else ""))
        clean.append(text)
        spoilt.append("".join(out))
    assert forms(spark, spoilt) == clean
    assert forms(spark, clean) == clean


def test_differing_and_empty(spark):
    df = spark.createDataFrame([(1, "тeкст", None), (1, "тeкст", "текст"), (2, "текст", "те​кст")], "row_no int, a string, b string")
    assert sorted(tuple(r) for r in charforms.differing(df, "row_no", ["a", "b"], "t").collect()) == [("t", 1, "a"), ("t", 1, "a"), ("t", 2, "b")]
    assert charforms.differing(df.limit(0), "row_no", ["a"], "t").count() == 0
    assert forms(spark, ["я" * 300_000 + "a"]) == ["я" * 300_000 + "а"]
