import random

import numpy as np
import pytest

from slovotok.llm import encodings, plaintext

ADJ = "короткий полезный городской зимний учебный печатный глубокий древний строгий весёлый узкий опасный верный чёрный южный новый".split()
NOUNS = "редактор указатель памятник сборник календарь черновик протокол маршрут рассказ словарь вестник лаборант учебник архив фонарь объём".split()
VERBS = "проверил дополнил отложил напечатал обсудил заметил сократил украсил измерил сохранил обновил запомнил выделил изучил".split()


#: Sentences of other languages and signs, none of which occurs in any table.
FOREIGN = {
    "Polish": ["Wczoraj wieczorem żółta łódź odpłynęła ze śluzy, a dzięcioł stukał w świerk.", "Ślą jaźń; żół ćwierć, źdźbło. Gżegżółka i pąk."],
    "Czech": ["Příliš žluťoučký kůň úpěl ďábelské ódy.", "Naše babička peče každý týden švestkový koláč."],
    "Hungarian": ["Árvíztűrő tükörfúrógép, őrült fűrész.", "A kertész délután öntözte a gyönyörű rózsákat."],
    "German": ["Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich.", "Möchten Sie müde Bären füttern? Bloß nicht, ärgerlich!"],
    "French": ["Dès Noël, où un zéphyr haï me vêt de glaçons würmiens, je dîne.", "Là-bas, l’hôtel où nous étions logés n’a plus d’étage; ça gêne."],
    "Spanish": ["El pingüino Wenceslao hizo kilómetros bajo exhaustiva lluvia; añoraba a su querido cachorro."],
    "Portuguese": ["À noite, vovô Kowalsky vê o ímã cair no pé do pinguim queixoso; açaí não há."],
    "Swedish": ["Flygande bäckasiner söka hwila på mjuka tuvor å strand."],
    "Danish": ["Høj bly gom vandt fræk sexquiz på wc; æblegrød og rødkål."],
    "Icelandic": ["Kæmi ný öxi hér, ykist þjófum nú bæði víl og ádrepa."],
    "Turkish": ["Pijamalı hasta yağız şoföre çabucak güvendi; ığdır, İstanbul."],
    "Romanian": ["Gheorghe, obezul, a reușit să obțină jucându-se un flux în Quebec; țânțarul își înșală."],
    "Lithuanian": ["Įlinkdama fechtuotojo špaga sublykčiojusi pragręžė apvalų arbūzą."],
    "Latvian": ["Muļķa hipiji mēģina brīvi nogaršot celofāna žņaudzējčūsku."],
    "Finnish": ["Törkylempijävongahdus, hyvää yötä älä mene."],
    "Ukrainian": ["Щастям б'єш жук їх глицю в фон й ґедзь пріє.", "Під горою її ґава їсть; є ще їжа, ґудзик і дзиґа."],
    "Belarusian": ["У рудога вераб’я ў сховішчы пад фатэлем ляжаць нейкія гаючыя зёлкі."],
    "Bulgarian": ["Жълтата дюля беше щастлива, че пухът, който цъфна, замръзна като гьон."],
    "Serbian": ["Фијуче ветар у шибљу, леди пасаже и куће иза њих и гунђа у оџацима.", "Љутња и џин, ђердан, ћуп. Ђорђе љуби."],
    "Macedonian": ["Ѕидарски пејзаж: шугав билмез со чудење џвака ќофте и кељ на туѓ цех.", "Ѓорѓи и Ќиро, ѕвезда, ѓавол."],
    "Kazakh": ["Щётка, фабрикадағы жұмыс: әке үйде өлең айтты, қыз көңілді, һәм ғылым."],
    "Greek": ["Ξεσκεπάζω την ψυχοφθόρα βδελυγμία.", "εσκεπ τα μικρά παιδιά έπαιζαν στην αυλή; ναι, βεβαίως."],
    "Hebrew": ["דג סקרן שט בים מאוכזב ולפתע מצא חברה."], "Arabic": ["نص حكيم له سر قاطع وذو شأن عظيم."],
    "Armenian": ["Բել դղյակի ձախ ժամն օֆ ազգությանը ցպահանջ."], "Georgian": ["სწრაფი ყავისფერი მელა ახტება."],
    "Chinese": ["視野無限廣,窗外有藍天。"], "Japanese": ["いろはにほへと ちりぬるを。"], "Vietnamese": ["Do bạch kim rất quý nên sẽ dùng để lắp vô xương."],
    "translit": ["zdravstvujte, eto pis'mo napisano latinicej, potomu chto klaviatura slomalas'."],
    "math": ["∑ xᵢ² ≤ 4π·r² ± 0,5; ∀ε>0 ∃δ: |f(x)−L|<ε, √2 ≈ 1,414", "α-частица, β-распад, Δt = 5 µс, 12 kΩ"],
    "symbols": ["☎ 8-800; ☂ ☀ ☁ ♫ ♬ ✂ ✈ ❤ → ⇐ ◄► ■ □ ▲▼ ¶ § © ™ ® ¿ ¡", "(¬‿¬) ¯\\_(ツ)_/¯ ಠ_ಠ", "¤ 15, £ 7, ¥ 900, ₽ 12, ₴ 5, € 3"],
    "box": ["╭────╮\n│ Яя │\n╰────╯", "╒═══╤═══╕\n│ а │ 7 │\n╘═══╧═══╛", "▁▂▃▄▅▆▇█ 80 % ░░▒▒▓▓", "■■■■□□□ ●●○○"],
    "marks": ["?????!!!!", "— ???? — !!! —", "******* ??? ...", "«???»", "?!?!?! ---- ????", "........?????......"],
    "mixed": ["Cлoвo нaписaнo c пoдмeнoй букв, a нe пoвpeждeнo.", "НЬЮ-ЙОРК, ЩЁКИ, ЪЫЬ, ЭЮЯ", "Съёмка, подъезд, объём, ёж, Ёлка, ЁЖ.", "пи́сать и писа́ть, за́мок и замо́к", "т е к с т в р а з р я д к у"],
}


def sentence(rng):
    return f"{rng.choice(ADJ).capitalize()} {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(ADJ)} {rng.choice(NOUNS)}, а {rng.choice(ADJ)} {rng.choice(NOUNS)} — «{rng.choice(ADJ)} {rng.choice(NOUNS)}»."


def text(rng, n):
    return " ".join(sentence(rng) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    made = plaintext.language_text(plaintext.ALPHABETS["Russian"], 60_000, 3)
    sample = [text(rng, 12) for _ in range(120)] + [made[i : i + 1000] for i in range(0, len(made), 1000)]
    return encodings.Model.unpacked(encodings.train(sample).packed())


@pytest.mark.parametrize("steps", [[("utf-8", "cp1252")], [("utf-8", "cp1251")], [("utf-8", "koi8-r")], [("utf-8", "cp866")], [("utf-8", "mac-cyrillic")], [("cp1251", "latin-1")], [("cp1251", "koi8-r")], [("cp1251", "cp866")], [("koi8-r", "cp1251")], [("cp866", "cp1251")], [("utf-8", "cp1251"), ("utf-8", "cp1252")]])
def test_garbled_parts_are_found_and_restored(model, steps):
    rng = random.Random(5)
    found = restored = total = 0
    for _ in range(25):
        before, part, after = text(rng, 4), sentence(rng).replace("«", "").replace("»", "").replace("—", "-"), text(rng, 4)
        wrong = part
        for true, w in steps:
            wrong = encodings.garble(wrong, true, w)
        whole = f"{before} {wrong} {after}"
        spans = model.spans(whole)
        found += bool(spans)
        fixed = set(model.restored(whole, spans).split())
        restored += sum(w in fixed for w in part.split()[1:])
        total += len(part.split()) - 1
    assert found == 25 and restored >= 0.85 * total


def test_ordinary_text_is_clean(model):
    rng = random.Random(9)
    for language, texts in FOREIGN.items():
        for t in texts:
            for whole in (t, t.lower(), f"{text(rng, 3)} {t}\n{text(rng, 3)}"):
                assert model.spans(whole) == [], (language, whole)


def test_words_of_other_languages_are_found_garbled(model):
    rng = random.Random(6)
    for language, true, wrong in (("German", "utf-8", "cp1252"), ("French", "utf-8", "cp1251"), ("Polish", "utf-8", "cp1250"), ("Ukrainian", "utf-8", "cp1251"), ("Spanish", "utf-8", "mac-roman")):
        bad = encodings.garble(FOREIGN[language][0], true, wrong)
        assert model.spans(f"{text(rng, 2)} {bad} {text(rng, 2)}"), language


def test_lost_letters(model):
    rng = random.Random(3)
    for sign in "?�":
        lost = "".join(sign if ord(c) > 127 else c for c in text(rng, 2))
        assert model.spans(f"{text(rng, 2)}\n{lost}\n{text(rng, 2)}")
    short = encodings.garble("— ", "utf-8", "cp1251")
    assert model.spans(f"{text(rng, 1)} {short}{text(rng, 1)}")


def test_bound_misses_nothing(model):
    """Where the bound lets a text pass as clean, Viterbi over the whole text agrees."""
    rng = random.Random(8)
    for k in range(30):
        t = text(rng, 2)
        if k % 2:
            a = rng.randint(0, len(t) - 20)
            t = t[:a] + encodings.garble(t[a : a + rng.randint(1, 12)], "utf-8", rng.choice(["cp1251", "cp1252", "koi8-r"])) + t[a + 12 :]
        assert bool(model.label(t, "").any()) == bool(model.spans(t))


def test_query(spark, model):
    rng = random.Random(2)
    bad = text(rng, 1) + " " + encodings.garble("вечерний рассказ о маршруте", "utf-8", "cp1252")
    rows = [(1, None, "x"), (2, "", "x"), (3, text(rng, 3), "x"), (4, bad, "x"), (4, bad, "x"), (5, text(rng, 9000) + bad, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    got = encodings.garbled(df, model).collect()
    assert sorted(r["doc_id"] for r in got) == [4, 4, 5] and all("вечерний рассказ" in r["restored"] for r in got)
    assert encodings.garbled(df.limit(0)).count() == 0


def test_long_spans_are_mended_as_short_ones(model):
    rng = random.Random(4)
    plain = lambda n: text(rng, n).replace("«", "").replace("»", "").replace("—", "-")
    state = next(k for k, s in enumerate(model.steps) if tuple(map(tuple, s)) == (("utf-8", "cp1252"),))
    for n in (1, 20):
        part = "э" + plain(n)
        wrong = encodings.garble(part, "utf-8", "cp1252")
        # The label begins inside the first letter.
        assert model.restored(f"Так: {wrong}", [(6, 5 + len(wrong), state)]).startswith("Так: э") and len(part) > 400 * (n > 1)
    parts = [plain(6), plain(1), plain(6)]
    wrong = [encodings.garble(p + " ", "utf-8", w) for p, w in zip(parts, ("cp1252", "cp1251", "cp1252"))]
    got = model.restored("".join(wrong), [(0, len("".join(wrong)), state)])
    assert sum(w in got for w in parts[1].split()) > len(parts[1].split()) // 2


def test_all_of_every_ordinary_document_trains_the_model(spark):
    rng = random.Random(7)
    # What is usual only after the first 1,500 characters is ordinary too.
    late = ["".join(c.upper() if i % 2 else c for i, c in enumerate(text(rng, 6))) for _ in range(40)]
    rows = [(i, text(rng, 20)[:1600] + " " + t) for i, t in enumerate(late)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert encodings.garbled(df).count() == 0
    # Also of more than a few hundred documents, wherever they are; others do not count.
    texts = [t for _, t in rows] + [f"{sentence(rng)}\n№ {i}" for i in range(900)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, ""), (-3, "naïve"), (-4, "a\0b")], "doc_id bigint, text string")
    pairs = encodings.counted(df.repartition(3))
    alone = encodings.Pairs(encodings.PLAIN)
    for t in reversed(texts):
        alone.add([t])
    assert pairs.between().sum() == sum(map(len, texts)) and (pairs.counts == alone.counts).all()


def test_pairs_of_garbled_texts_follow_from_pairs():
    rng = random.Random(1)
    some = (encodings.PLAIN, "абвгдеёАБВНПРЭЯШноя «»—–…№•→\n .,!?-", "абвгдеж нопрстуф А—", "abc —", "xyz")
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for chars in some for _ in range(40)]
    pairs = encodings.Pairs(encodings.PLAIN)
    pairs.add(texts)
    letters = sorted({c for name in encodings.WRONG for c in encodings._decoding(name)} | {"�"})
    size = len(letters) + 1
    lookup = np.zeros(0x110000, np.uint16)
    lookup[[ord(c) for c in letters]] = np.arange(1, size)
    for name, steps in encodings.states():
        true = steps[0][0] if steps else "utf-8"
        known = lambda t, true=true: "".join(c for c in t if true == "utf-8" or c in encodings._encoding(true))
        able = [t for t in texts if true == "utf-8" or len(known(t)) >= 0.97 * len(t) and not known(t).isascii()]
        for case in (str, str.upper):
            for k, (images, _) in enumerate(encodings._spoilt_characters(pairs.characters, case, name, steps)):
                got = sum(pairs.written([images], lookup, size, true))
                image = dict(zip(pairs.characters, images))
                want = ["".join(image[c] for c in t) for t in able]
                assert np.allclose(got, encodings._count([(t, 1.0) for t in want], lookup, size)), (name, case, k)
                if steps and k == 0:
                    whole = [case(known(t)) for t in able]
                    for step in steps:
                        whole = [encodings.garble(t, *step) for t in whole]
                    assert whole == want, (name, case)
