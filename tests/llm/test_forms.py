import random
import unicodedata

from tidemark.llm import forms


def brute(text):
    return unicodedata.normalize("NFC", "".join(map(forms.fold, text)))


SAMPLES = [
    None, "", " ", "​‍", "推", "推​", "ＫＹ１２", "KY12", "Ｔｅst", "Тест", "é", "é", "É", "ạ́", "ạ́", "ё", "ё",
    "重⼯", "重工", "重エ", "金金", "각", "각", "x​́", "́x", "😀‍😀", "a b", "a　b", "a b", "①", "1", "l", "I", "漢" * 20_000 + "​",
]


def frame(spark, texts):
    return spark.createDataFrame([("f", i, t, "clash", 1) for i, t in enumerate(texts)], "field_name string, id bigint, text string, k string, pos int")


def test_forms_equal_brute_force(spark):
    rng = random.Random(3)
    alphabet = "aéeoK１Ｋ̣́̈​­Ао工エ⼯ 　﻿各ᅡᄀᆨ"
    texts = SAMPLES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    got = {r.id: r.form for r in forms.forms(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == (None if text is None else brute(text)), repr(text)


def test_pairs_equal_brute_force(spark):
    texts = SAMPLES + ["推", "推", "推﻿"]
    got = sorted((r.id_a, r.id_b) for r in forms.lookalike_pairs(frame(spark, texts)).collect())
    want = [
        (i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
        if texts[i] is not None and texts[j] is not None and texts[i] != texts[j] and brute(texts[i]) == brute(texts[j])
    ]
    assert got == sorted(want) and got


def test_kept_apart():
    for a, b in (("a", "A"), ("0", "O"), ("1", "l"), ("e", "é"), ("①", "1"), ("…", "...")):
        assert brute(a) != brute(b)


def test_fields_and_empty_table(spark):
    rows = spark.createDataFrame([("f", 1, "推"), ("g", 2, "推​")], "field_name string, id bigint, text string")
    assert forms.lookalike_pairs(rows).count() == 0
    assert forms.forms(rows.limit(0)).count() == 0 and forms.lookalike_pairs(rows.limit(0)).count() == 0


def test_shown_form_keeps_letters_among_their_own_script(spark):
    texts = ["スーパー", "重エ", "買ニ張", "привет", "Тessarik", "スーパ́ー", "ﾛｰﾝ", "ー", "кот Tест"]
    got = {r.id: (r.form, r.shown) for r in forms.forms(frame(spark, texts)).collect()}
    assert got[0] == (brute("スーパー"), "スーパー") and got[0][0] != "スーパー"
    assert got[1] == ("重工", "重工") and got[2] == ("買二張", "買二張")
    assert got[3][1] == "привет" and got[4] == ("Tessarik", "Tessarik")
    assert got[5][1].startswith("スーパ") and got[6][1] == "ローン" and got[7][1] == "一"
    assert all(f == brute(t) for t, (f, _) in zip(texts, (got[i] for i in range(len(texts)))))


def test_classes_count_the_pairs(spark):
    texts = [*SAMPLES, "推", "推", "推﻿"]
    pairs = [(r.id_a, r.id_b) for r in forms.lookalike_pairs(frame(spark, texts)).collect()]
    links = {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = {r.id: (r.class_id, r.links) for r in forms.lookalike_classes(frame(spark, texts)).collect()}
    assert {i: n for i, (_, n) in got.items()} == links
    assert all(got[a][0] == got[b][0] == min(i for i in got if got[i][0] == got[a][0]) for a, b in pairs)


def test_a_crowded_form_costs_what_its_pairs_cost(spark):
    """Equal texts never meet: half a million equal rows and one variant give as many pairs."""
    n = 500_000
    rows = spark.range(n).selectExpr("'f' as field_name", "id", "'推' as text").union(spark.createDataFrame([("f", n, "推\u200b")], "field_name string, id bigint, text string"))
    found = forms.lookalike_pairs(rows).selectExpr("count(*) as n", "min(id_b) as low", "count(distinct id_a) as a").first()
    assert tuple(found) == (n, n, n)
    assert forms.lookalike_classes(rows).where(f"id = {n} and links = {n} and class_id = 0").count() == 1
