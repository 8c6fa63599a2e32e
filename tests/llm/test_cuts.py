import random

import numpy as np

from tidemark.llm import cuts


def forum(n=4000):
    rng = random.Random(2)
    subject = ["外資", "主力", "散戶", "投信"]
    tail = ["今天又倒貨{}張，看起來很疲弱", "成本大概{}，所以不會跌太深", "連續買超{}張，大家都很樂觀", "說要等{}以下才會進場"]
    rows, cut = [], set()
    for i in range(n):
        source = ("app", "web", "poll")[i % 3]
        text = "，".join(rng.choice(subject) + rng.choice(tail).format(rng.randint(10, 99999)) for _ in range(rng.randint(1, 3)))
        if source == "app" and len(text) > 30:
            text, _ = text[:30], cut.add(i)
        elif source == "poll" and rng.random() < 0.03 and len(text) > 16:
            text, _ = text[: rng.randint(6, len(text) - 2)], cut.add(i)
        rows.append(("comments", i, source, text, 1))
    return rows, cut


def test_finds_planted_cuts(spark):
    rows, cut = forum()
    extra = [("comments", 10_001, "web", None, 1), ("comments", 10_002, None, "推", 1), ("comments", 10_003, "web", "  ", 1), ("comments", 10_004, "web", "", 1), ("comments", 10_005, "web", "長" * 30_000, 1), ("comments", 10_006, "web", "外資今天又�", 1)]
    df = spark.createDataFrame(rows + extra, "src string, row_id bigint, source string, text string, size int")
    got = {r.row_id: r.p_cut for r in cuts.scored(df, []).collect()}
    assert len(got) == len(rows) + len(extra)
    found = {i for i, p in got.items() if p >= 0.5 and i < 10_000}
    assert len(found & cut) / len(found) > 0.95 and len(found & cut) / len(cut) > 0.85
    assert got[10_001] == got[10_003] == got[10_004] == 0 and got[10_006] == 1.0
    bounds = [(r.source, r.unit, r["size"]) for r in cuts.limits(cuts.measured(df)).collect()]
    assert ("app", "chars", 30) in bounds and all(s == "app" for s, _, _ in bounds)
    rates = {r.source: r.cut_share for r in cuts.rates(cuts.scored(df, [])).collect()}
    assert rates["app"] > 0.3 > rates["poll"] > rates["web"]


def test_censored_fit_recovers_the_lengths():
    rng = np.random.default_rng(0)
    true = np.exp(rng.normal(3.3, 0.4, 20_000)).astype(int) + 1
    seen, n = np.unique(np.minimum(true, 30), return_counts=True)
    w, m, s = cuts.fit_censored(seen.astype(float), n.astype(float), 30)
    beyond = cuts._mass((w, m, s), 30, np.inf)
    assert abs(beyond - (true >= 30).mean()) < 0.03


def test_no_limit_without_a_spike():
    import pandas as pd

    rng = np.random.default_rng(0)
    sizes, n = np.unique(np.exp(rng.normal(3, 0.5, 5000)).astype(int) + 1, return_counts=True)
    hist = pd.DataFrame({"unit": "chars", "size": sizes, "broken": False, "n": n})
    assert cuts.find_limits(hist) == []


def test_empty(spark):
    df = spark.createDataFrame([], "src string, row_id bigint, source string, text string")
    assert cuts.scored(df, ["甲乙"]).count() == 0


def test_contexts_do_not_depend_on_the_batch():
    made = cuts.Contexts(["蓼苔重工"])
    texts = ["買蓼苔重工123張", "推", "", "看蓼苔", "abc 12.5"]
    together, ends, _ = made.of(texts)
    for i, text in enumerate(texts):
        alone, end, _ = made.of([text])
        if ends[i] >= 0:
            assert [h[ends[i]] for h in together] == [h[end[0]] for h in alone]


def lengths(seed, n, mean=3.0, deviation=0.5):
    return np.exp(np.random.default_rng(seed).normal(mean, deviation, n)).astype(int) + 1


def unit_hist(sizes):
    import pandas as pd

    seen, n = np.unique(sizes, return_counts=True)
    return pd.DataFrame({"unit": "chars", "size": seen, "broken": False, "n": n})


def test_a_limit_in_the_body_needs_no_fourfold_spike():
    true = lengths(1, 1220, 2.6, 0.25)
    found = cuts.find_limits(unit_hist(np.minimum(true, 22)))
    assert [f[:2] for f in found] == [("chars", 22)]
    assert (true == 22).sum() * 4 > (true >= 22).sum()  # no spike of four times the expected
    assert abs(found[0][2] - (true > 22).sum() / (true >= 22).sum()) < 0.15


def test_rare_and_several_limits_are_found():
    true = lengths(1, 20_000)
    assert [f[:2] for f in cuts.find_limits(unit_hist(np.minimum(true, 60)))] == [("chars", 60)]  # holds 1 % of the rows
    mixed = np.where(np.random.default_rng(3).random(len(true)) < 0.5, np.minimum(true, 30), np.minimum(true, 45))
    assert sorted(f[:2] for f in cuts.find_limits(unit_hist(mixed))) == [("chars", 30), ("chars", 45)]


def test_several_limits_of_a_source_keep_each_row_once(spark):
    rng = np.random.default_rng(5)
    true = lengths(1, 4000)
    shown = np.where(rng.random(len(true)) < 0.5, np.minimum(true, 30), np.minimum(true, 45))
    letters = np.array(list("外資主力散戶投信今天又倒貨看起來很疲弱"))
    rows = [("comments", i, "web", "".join(rng.choice(letters, n))) for i, n in enumerate(shown)]
    df = spark.createDataFrame(rows, "src string, row_id bigint, source string, text string")
    assert sorted(r["size"] for r in cuts.limits(cuts.measured(df)).collect() if r["unit"] == "chars") == [30, 45]
    got = [r.row_id for r in cuts.scored(df, []).collect()]
    assert sorted(got) == list(range(len(rows)))


def test_names_in_several_parts_match_as_in_one():
    from tidemark.llm.names import Finder

    rng = random.Random(4)
    listed = ["".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(2, 5))) for _ in range(300)]
    text = "".join(rng.choice("甲乙丙丁戊") for _ in range(5000))
    assert list(Finder(listed, 7)(text)) == list(Finder(listed)(text))


def test_an_ellipsis_is_judged_by_what_stands_before_it(spark):
    rows, _ = forum(3000)
    more = [("comments", 20_000, "web", "外資成本大概123，所以不會跌太深…", 1), ("comments", 20_001, "web", "外資成本大概123，所以不會…", 1), ("comments", 20_002, "web", "…", 1)]
    got = {r.row_id: r.p_cut for r in cuts.scored(spark.createDataFrame(rows + more, "src string, row_id bigint, source string, text string, size int"), []).collect()}
    assert got[20_000] < 0.5 <= got[20_001] and got[20_002] < 0.5


def test_cut_texts_do_not_vouch_for_each_other(spark):
    """A context that is cut oftener than once in a hundred times is still seen as cut."""
    rng = random.Random(6)
    rows = [("comments", i, "web", f"今天{rng.randint(10, 9999)}元賣出，詳見 https://forum.example/{rng.randint(1, 999)}.html") for i in range(600)]
    rows += [("comments", 1000 + i, "web", f"看好這檔{i}張，很安心") for i in range(600)]
    cut = {2000 + i for i in range(30)}
    rows += [("comments", i, "web", f"今天{i}元賣出，詳見 https://fo") for i in cut]
    got = {r.row_id: r.p_cut for r in cuts.scored(spark.createDataFrame(rows, "src string, row_id bigint, source string, text string"), []).collect()}
    assert {i for i, p in got.items() if p >= 0.5} == cut
