from tidemark.llm import canonical as C

TARGETS = [("5777", "蓼苔重工"), ("6394", "柚澗材"), ("3101", "潭蝶-KY"), ("00947U", "翡沼缽優選30"), ("7763", "鶴霓"), ("1111", "雙名"), ("2222", "雙名"), ("9999", None)]
NICKS = [("5777", "蓼珀神"), ("6394", "QK"), ("3101", "qk"), ("0000", "無主"), ("6394", None)]


def frames(spark, values):
    comments = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "comment_id bigint, stock_targets string, value string")
    return comments, spark.createDataFrame(TARGETS, "stock_no string, stock_name string"), spark.createDataFrame(NICKS, "stock_no string, stock_nickname string")


def test_resolved(spark):
    cases = {
        "5777": "5777", "５７７７": "5777", "代號5777": "5777", "5777號": "5777", "$5777": "5777", "5777.TW": "5777", "5777蓼苔重工": "5777", "蓼苔重工（5777）": "5777",
        "蓼苔重工": "5777", "蓼苔重工股份有限公司": "5777", "蓼 苔 重 工": "5777", "蓼​苔重工": "5777", "蓼重工": "5777", "蓼苔重蘅": "5777", "蒔蓼苔重工": "5777", "蓼苔工重": "5777",
        "潭蝶KY": "3101", "潭蝶-ky": "3101", "潭蝶‐KY": "3101", "OO947U": "00947U", "翡沼钵优选30": "00947U", "霓鶴": "7763", "蓼珀神啦": "5777", "QK": "6394", "qk": "3101",
        "Qk": "", "9999": "9999", "1234": "", "unknown": "", "半導體": "", "無主": "", "鶴": "", "隼苔蕪杉商行": "",
    }
    got = {r.comment_id: r.stock_no for r in C.resolved(*frames(spark, [f'["{v}"]' for v in cases])).collect()}
    assert {v: got[i] for i, v in enumerate(cases) if v != "Qk"} == {v: w for v, w in cases.items() if v != "Qk"}
    assert got[list(cases).index("Qk")] in ("6394", "3101")


def test_shapes_positions_and_odd_input(spark):
    values = ['["", null, {}, "5777", 6394, {"unknown": "5777"}, {"6394": "5777"}]', '"5777"', '{"x": ""}', "5777", None, "", "[]", "not json", '["5777"', "[[]]", '["' + "長" * 5000 + '"]']
    got = sorted((r.comment_id, r.target_pos, r.stock_no) for r in C.resolved(*frames(spark, values)).collect() if r.comment_id not in (7, 8, 9))
    assert got == [(0, 3, "5777"), (0, 4, "6394"), (0, 5, "5777"), (0, 6, "6394"), (1, 0, "5777"), (2, 0, ""), (3, 0, "5777"), (10, 0, "")]


def test_ties_go_to_the_code_named_most(spark):
    values = ['["雙名"]', '["2222"]', '["2222"]', '["1111"]']
    got = {r.comment_id: r.stock_no for r in C.resolved(*frames(spark, values)).collect()}
    assert got[0] == "2222"
    assert {r.comment_id: r.stock_no for r in C.resolved(*frames(spark, values[:1])).collect()} == {0: "1111"}


def test_unmatched_and_empty(spark):
    comments, targets, nicks = frames(spark, ['["foo", "foo", "5777"]', '["bar"]'])
    assert sorted((r.value, r.n) for r in C.unmatched(comments, targets, nicks).collect()) == [("bar", 1), ("foo", 2)]
    assert C.resolved(comments.limit(0), targets, nicks).count() == 0
    assert [r.stock_no for r in C.resolved(comments, targets.limit(0), nicks.limit(0)).collect()] == ["", "", "", ""]


def test_join_loses_no_similar_pair(spark):
    import random

    rng = random.Random(8)
    names = ["".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(2, 5))) for _ in range(80)]
    known = spark.createDataFrame([(str(i), "name", n, C.tokens(n)) for i, n in enumerate(names)], "stock_no string, kind string, entry string, tokens array<string>")
    typed = sorted({"".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(2, 5))) for _ in range(60)})
    values = spark.createDataFrame([(v, 1, "name", v, C.tokens(v)) for v in typed], "value string, n bigint, kind string, reading string, tokens array<string>")
    got = {(r.value, r.stock_no) for r in C.similar(values, known).collect()}
    want = set()
    for v in typed:
        for i, n in enumerate(names):
            a, b = set(C.tokens(v)), set(C.tokens(n))
            j = len(a & b) / len(a | b)
            if j >= C.THRESHOLD - 1e-9 or (max(len(a), len(b)) <= C.SHORT and sorted(v) == sorted(n)):
                want.add((v, str(i)))
    assert got == want


def test_simplified_forms_by_rule(spark):
    table = C.simplified(spark)
    assert 2000 < len(table) < 5000
    for traditional, simple in zip("雙櫓檸簷蕪蒔靄霽箏鮭獺驢礫硯網電鷺鳶龜鬱", "双橹柠檐芜莳霭霁筝鲑獭驴砾砚网电鹭鸢龟郁"):
        assert table[ord(traditional)] == simple
    targets = spark.createDataFrame([("1", "靄櫓檸電"), ("2", "蕪硯鷺"), ("3", "鬱龜科")], "stock_no string, stock_name string")
    typed = spark.createDataFrame([(i, f'["{v}"]') for i, v in enumerate(["霭橹柠电", "芜砚鹭", "郁龟科", "靄橹檸电", "蕪硯\uf93a"])], "comment_id bigint, stock_targets string")
    nicks = spark.createDataFrame([], "stock_no string, stock_nickname string")
    assert [r.stock_no for r in C.resolved(typed, targets, nicks).orderBy("comment_id").collect()] == ["1", "2", "3", "1", "2"]
