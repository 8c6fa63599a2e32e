from datetime import datetime

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import collections as C
from tidemark.functions import text as T
from tidemark.functions import times
from tidemark.functions.distance import restricted_distance, restricted_distance_col, within_one_edit


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_text(spark):
    assert column(spark, ["[標的] [x]", "none", "[]", None, "a[b]c"], T.title_tag) == ["標的", "Unknown", "Unknown", "Unknown", "b"]
    assert column(spark, ["來自: 1.2.3.4 (北)\n來自: 5.6.7.8", "x", None], T.last_sender_ip) == ["5.6.7.8", "Unknown", "Unknown"]
    assert column(spark, ["來自: 1.2.3.4 (北)\n來自: 5.6.7.8 (東)", "來自: 1.2.3.4", None], T.last_sender_country) == ["東", "Unknown", "Unknown"]
    assert column(spark, ["a\n--\nb\n--\nc", "　whole text ", None, "\n--\n"], T.cut_at_last) == ["a\n--\nb", "whole text", None, ""]
    assert column(spark, ["推 ", "噓", "→", None], T.push_score) == [1, -1, 0, 0]
    assert column(spark, [": hi", ":", "", None], T.drop_first) == [" hi", "", "", None]
    assert column(spark, ["abcd", "abc", "甲乙丙丁戊", None], T.wrapped_label) == ["abcd\n", "abc", "甲乙丙丁\n戊", None]
    assert column(spark, ["a\n\n", "a", None], T.without_last_newline) == ["a\n", "a", None]
    assert column(spark, ['say \\"x\\"'], T.single_quoted) == ["say 'x'"]
    assert column(spark, ["買 GG,gg！5777", "", None], T.plain_tokens) == [["買", "GG", "gg", "5777"], [], []]
    assert column(spark, ["買進abc 12.5", "", None], T.token_count) == [6, 0, 0]


def test_times(spark):
    day = datetime(2024, 6, 1, 8, 0, 7)
    assert column(spark, ["Sat Jun  1 08:00:07 2024", "Tus Jun 1 08:00:07 2024", "bad", None], times.forum_time) == [day, day, None, None]
    year = F.to_timestamp_ntz(F.lit("2024-12-31 00:00:00"))
    got = column(spark, ["02/29 10:30", "01/02 10:30", "2023-05-06 07:08", "Unkn-01-01 00:00", None], lambda v: times.comment_time(v, year))
    assert got == [datetime(2024, 2, 29, 10, 30), datetime(2024, 1, 2, 10, 30), datetime(2023, 5, 6, 7, 8), None, None]
    assert column(spark, ["02/29 10:30"], lambda v: times.comment_time(v, F.to_timestamp_ntz(F.lit("2023-01-01 00:00:00")))) == [None]


def test_collections(spark):
    assert column(spark, ['["a", 1, null, {"b": 2}]', '"x"', "7", "bad json", None, "[]"], C.json_items)[:3] == [["a", "1", None, '{"b":2}'], ["x"], ["7"]]
    assert [r and (r.key, r.value) for r in column(spark, ['{"bb": "1", "a": "2"}', "{}", "text", None], C.first_pair)] == [("a", "2"), None, None, None]
    assert column(spark, [["n1", "c1", "n2", "c2", "n3"], ["n1", "c", "n2", "c"], [], None], C.alternating_map, "array<string>") == [{"c1": "n1", "c2": "n2"}, {"c": "n2"}, {}, None]
    assert column(spark, [[""], ["a", None, ""], None], C.without_empty, "array<string>") == [[], ["a"], None]
    assert column(spark, [["a", "b"], []], C.index_map, "array<string>") == [{"0": "a", "1": "b"}, {}]
    for n in (0, 1, 44, 45, 46, 90, 91):
        parts = column(spark, [[str(i) for i in range(n)]], lambda v: C.chunk(v, 45), "array<string>")[0]
        assert [x for p in parts for x in p] == [str(i) for i in range(n)] and all(len(p) <= 45 for p in parts) and len(parts) == -(-n // 45)
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"b": "3"}), ({"a": "1"}, None)], "l map<string,string>, r map<string,string>")
    assert [r[0] for r in df.select(C.merged(F.col("l"), F.col("r"))).collect()] == [{"a": "1", "b": "3"}, {"b": "3"}, {"a": "1"}]
    df = spark.createDataFrame([("", None), (None, ""), ("a", "b"), ("a\x1fb", None)], "x string, y string")
    assert len({r[0] for r in df.select(C.fingerprint(F.col("x"), F.col("y"))).collect()}) == 4


def slow_distance(a, b):
    """The definition, by recursion over prefixes."""
    memo = {}

    def d(i, j):
        if (i, j) not in memo:
            if not i or not j:
                memo[i, j] = i + j
            else:
                best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    best = min(best, d(i - 2, j - 2) + 1)
                memo[i, j] = best
        return memo[i, j]

    return d(len(a), len(b))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_distance(a, b):
    assert restricted_distance(a, b) == slow_distance(a, b) == restricted_distance(b, a)


def test_distance_column(spark):
    df = spark.createDataFrame([("ca", "abc"), ("ab", "ba"), (None, "a"), ("第一", "第一銅")], "a string, b string")
    assert [r[0] for r in df.select(restricted_distance_col("a", "b")).collect()] == [3, 1, None, 1]


def test_distance_column_equals_the_definition(spark):
    import itertools
    import random

    rng = random.Random(1)
    words = ["", "a", "ab", "ba", "abab", "甲乙", "乙甲", "😀a", "a😀"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    pairs = list(itertools.product(words, words))
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", restricted_distance_col("a", "b").alias("d"), within_one_edit(F.col("a"), F.col("b")).alias("near")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert r.d == restricted_distance(r.a, r.b) and r.near == (r.d <= 1), r
