import random

import numpy as np

from slovotok.llm import leaks

_STEMS = [a + b for a in "бор вод гор дал кон лип мор нов пал рос сад тон".split() for b in "ник тель щик овка анин ист арь".split()]
NOUNS = _STEMS + "редактор указатель памятник сборник календарь черновик протокол маршрут рассказ словарь вестник лаборант учебник архив фонарь".split()  # noqa: RUF005
VERBS = "проверил дополнил отложил напечатал обсудил заметил сократил украсил измерил сохранил обновил запомнил выделил".split() + [w + "ил" for w in _STEMS]
ADJ = [w + "овый" for w in _STEMS] + "короткий полезный городской зимний учебный печатный глубокий древний строгий весёлый узкий опасный верный".split()


def sentence(rng):
    return f"{rng.choice(ADJ).capitalize()} {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(ADJ)} {rng.choice(NOUNS)} {rng.choice(ADJ)}"


def text(rng, n):
    return ". ".join(sentence(rng) for _ in range(n)) + "."


def spoil(rng, words, how):
    words = list(words)
    for i in range(len(words)):
        r = rng.random()
        if how == "marks" and r < 0.3:
            words[i] = rng.choice(["<b>{}</b>", "*{}*", "{}[1]", "«{}»"]).format(words[i])
        elif how == "letters" and r < 0.3:
            words[i] = words[i].replace("о", "o").replace("е", "e").replace("ё", "е").upper()
        elif how == "spelling" and r < 0.12 and len(words[i]) > 4:
            k = rng.randint(1, len(words[i]) - 2)
            words[i] = words[i][:k] + words[i][k + 1 :]
        elif how == "words" and r < 0.1:
            words[i] = rng.choice(["иначе", "лишь", ""])
    return " ".join(w for w in words if w)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, e).select("doc_id", "item_id").collect())


def test_search_against_plain_find():
    rng = random.Random(3)
    items = [(i, text(rng, 6)) for i in range(20)]
    search = leaks.Search(items)
    letters, _, _ = search.stream([text(rng, 40) + items[k][1] for k in range(20)])
    where, string = search.occurrences(letters)
    got = set(zip(where.tolist(), search.at[string].tolist(), strict=True))
    body, patterns = bytes(letters), {int(a): bytes(search.letters[a : a + leaks.LENGTH]) for a in search.at}
    want = set()
    for a, p in patterns.items():
        i = body.find(p)
        while i >= 0:
            want.add((i, a))
            i = body.find(p, i + 1)
    assert got == want and len(got) > 500


def test_leaks_are_found_and_others_are_not(spark):
    rng = random.Random(11)
    items = [(i, ("Исправьте ошибки в тексте: " if i % 3 == 0 else "") + text(rng, 8)) for i in range(30)]
    docs, want = [], []
    for i, t in items:
        words = leaks.without_instruction(t).split()
        for k, how in enumerate(("none", "marks", "letters", "spelling", "words")):
            part = words if k % 2 else words[: max(len(words) // 3 + 3, 13)]
            docs.append((1000 * i + k, text(rng, 30) + " " + spoil(rng, part, how) + " " + text(rng, 5)))
            want.append((1000 * i + k, i))
        docs.append((1000 * i + 10, text(rng, 10) + " " + " ".join(words[4:10]) + ". " + text(rng, 10)))
        shuffled = words[:]
        rng.shuffle(shuffled)
        docs.append((1000 * i + 11, " ".join(shuffled)))
    docs.append((5, "Исправьте ошибки в тексте: " + text(rng, 3)))
    assert run(spark, docs, items) == sorted(want)


def test_edge_cases(spark):
    rng = random.Random(1)
    item = text(rng, 8)
    long = text(rng, 4000) + " " + item
    docs = [(1, None), (2, ""), (3, "?!"), (4, long), (4, long), (5, "короткий текст")]
    items = [(7, item), (7, item), (8, None), (9, ""), (10, "слишком мало слов")]
    assert run(spark, docs, items) == [(4, 7)] * 4
    assert run(spark, docs[:0], items) == [] and run(spark, docs, items[:0]) == []


def test_canonical_letters():
    table = leaks.letter_table()
    code = lambda c: int(table[ord(c)])
    assert code("о") == code("O") == code("ο") == code("О") and code("е") == code("ё") and code("и") == code("й") and code("1") == code(" ") == 0
    assert len(np.unique(table[[ord(c) for c in "абвгдежзиклмнопрстуфхцчшщъыьэюя"]])) == 31


def test_shortest_passages_with_changed_words_are_aligned():
    rng = random.Random(23)
    items = [(i, text(rng, 5)) for i in range(60)]
    search, docs = leaks.Search(items), []
    for _, t in items:
        words = t.split()[7:17]
        for changed in ((3, 6), (2, 4, 7), (2, 4, 6, 8)):
            part = [rng.choice(["иначе", "лишь", "впрочем"]) if k in changed else w for k, w in enumerate(words)]
            docs.append(f"{text(rng, 6)} {' '.join(part)} {text(rng, 4)}")
    got = {(t, i) for t, i, _ in search.candidates(docs)}
    assert {(k, k // 3) for k in range(len(docs))} <= got


def test_a_changed_third_of_the_words_still_leaks(spark):
    item = "Соня мыла пол, кот ел суп, дед пил чай, пёс спал, мать шила, а сын пел о море и небе"
    part = "кот ел кашу, дед пил квас, пёс спал, мать пела, а сын"
    assert run(spark, [(1, f"Было утро. {part}. Стало тихо.")], [(7, item)]) == [(1, 7)]


def test_nine_words_are_no_leak_and_ten_are():
    assert not leaks.enough(9, 26) and not leaks.enough(9, 20) and leaks.enough(10, 30) and not leaks.enough(10, 31)


def test_mark_up_of_any_length_is_seen_through():
    tag = '<a href="' + "x" * 500 + '" class=\'y\' data-z>'
    assert leaks.without_markup(f"{tag}слово</a> [12] раз [ссылка](http://{'a' * 300}) &thetasym; a < b и c > d [в скобках остаётся]").split() == ["слово", "раз", "[ссылка", "a", "<", "b", "и", "c", ">", "d", "[в", "скобках", "остаётся]"]
    assert leaks.without_instruction("Расставьте " + "очень " * 90 + "нужные знаки: Вот текст.") == "Вот текст."


def misspelt(rng, word):
    if len(word) < 3:
        return word
    k = rng.randrange(len(word) - 1)
    return rng.choice((word[:k] + word[k + 1 :], word[:k] + rng.choice("авекмнорстух") + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :]))


def test_recall_of_misspelt_passages():
    """The whole operator against the definition: passages of a third of the item and three words, in which words are misspelt."""
    rng = random.Random(31)
    items = [(i, text(rng, 8)) for i in range(150)]
    search = leaks.Search(items)
    for share, least in ((0.1, 0.98), (0.3, 0.97), (0.5, 0.93)):
        docs = []
        for _, t in items:
            words = t.split()
            n, a = len(words) // 3 + 3, rng.randrange(len(words) * 2 // 3 - 3)
            docs.append(text(rng, 6) + " " + " ".join(misspelt(rng, w) if rng.random() < share else w for w in words[a : a + n]) + " " + text(rng, 6))
        found = search.candidates(docs)
        counts = search.leaked([(part, i) for _, i, part in found])
        got = {t for (t, i, _), n in zip(found, counts, strict=True) if t == i and leaks.enough(n, len(search.words[i]))}
        assert len(got) >= least * len(items), (share, len(got))


def test_best_passage_is_found_beside_a_longer_fragment_out_of_order():
    item = [f"{chr(1072 + i)}{chr(1072 + i // 2)}слово{chr(1090 - i)}" for i in range(28)]
    signed = leaks.Signed(item)
    doc = leaks.Signed([*item[20:27], *item[0:6], "иное", *item[7:14]])
    assert leaks.best_passages([doc], [signed]) == [14]
    joined = leaks.Signed([item[0] + item[1], *item[2:8], item[8][:4], item[8][4:], *item[9:12]])
    assert leaks.best_passages([joined], [signed]) == [12]


def test_blocks_of_items(spark, monkeypatch):
    rng = random.Random(17)
    items = [(i, text(rng, 6)) for i in range(12)]
    docs = [(i, text(rng, 5) + " " + t) for i, t in items]
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 900)
    assert run(spark, docs, items) == [(i, i) for i, _ in items]
