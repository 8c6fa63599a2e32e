import random

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle as pickle

from tidemark.llm import abuse, gru


def rows(n=700):
    rng = random.Random(1)
    who, what = ["樓上", "原PO", "你這種人"], ["真的是豬腦袋", "根本廢物", "滾出去"]
    calm = ["外資又倒貨{}張", "成本大概{}", "看好", "明天會漲{}%吧", "先掛{}張", "這檔很穩"]
    out = []
    for _ in range(n):
        bad = rng.random() < 0.3
        parts = [rng.choice(calm).format(rng.randint(1, 9999)) for _ in range(rng.randint(1, 3))]
        if bad:
            parts.insert(rng.randint(0, len(parts)), rng.choice(who) + rng.choice(what))
        out.append(("，".join(parts), int(bad)))
    return out


def test_gradient():
    p = {k: v.astype(np.float64) for k, v in gru.initial(3).items()}
    chars, words = gru.features(abuse.coded(["你這種人真的是豬腦袋", "what a day", "漲"]))
    y, w, rng = np.array([1.0, 0, 1]), np.ones(3), random.Random(1)
    _, grad = gru.step(p, chars, words, y, w)
    for name in ("Wf", "Uf", "bf", "Wb", "Ub", "bb", "Wa", "va", "wo", "bo"):
        at = tuple(rng.randrange(n) for n in p[name].shape)
        old, e = p[name][at], 1e-3
        p[name][at] = old + e
        up, _ = gru.step(p, chars, words, y, w)
        p[name][at] = old - e
        down, _ = gru.step(p, chars, words, y, w)
        p[name][at] = old
        assert abs((up - down) / (2 * e) - grad[name][at]) < 1e-4, name


def test_learns_despite_wrong_labels_and_masks(spark):
    train, test = rows(), rows(300)[::-1]
    wrong = random.Random(5)
    labels = [1 - y if wrong.random() < 0.05 else y for _, y in train]
    reader = abuse.Reader(["蓼苔重工"])
    params = abuse.train([t for t, _ in train], labels, reader, [t for t, _ in rows(200)], steps=400)
    texts = [t for t, _ in test]
    score = abuse.row_scores(texts, reader, gru.Scorer(params), abuse.Memory())
    hit, y = score >= 0.5, np.array([v for _, v in test])
    assert (hit & (y == 1)).sum() / max(1, hit.sum()) > 0.9 and (hit & (y == 1)).sum() / (y == 1).sum() > 0.9
    df = spark.createDataFrame([("c", i, None, t, 1) for i, t in enumerate([*texts, None, "", " ", "漲" * 20_000 + "，樓上根本廢物"])], "src string, row_id bigint, source string, text string, score int")
    got = {r.row_id: r.score for r in abuse.scored(df, params, ["蓼苔重工"]).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], score, atol=1e-4)
    n = len(texts)
    assert got[n] == got[n + 1] == got[n + 2] == 0 and got[n + 3] > 0.5


def test_windows_cover_the_text():
    reader = abuse.Reader([])
    text = reader.normal(["今天外資又倒貨，" + "".join(chr(0x5000 + i) for i in range(90)) + "。\n完"])[0]
    seen = set()
    for w in reader.windows(text, abuse.STRIDE):
        at = text.find(w)
        seen |= set(range(at, at + len(w)))
    assert {i for i, c in enumerate(text) if not abuse._BREAKS.match(c) and not c.isspace()} <= seen


def test_without_labels(spark):
    assert abuse.train([], [], abuse.Reader([])) is None
    assert abuse.train(["a", "b"], [1, 1], abuse.Reader([])) is None
    df = spark.createDataFrame([("c", 1, "s", "x")], "src string, row_id bigint, source string, text string")
    assert [r.score for r in abuse.scored(df, None, []).collect()] == [0.0]
    assert [r.abusive_rows for r in abuse.rates(abuse.scored(df, None, [])).collect()] == [0]
    labels = spark.createDataFrame([("c", 1, 1, "r"), ("c", 9, 0, "r"), ("c", 1, None, "r")], "src string, row_id bigint, is_abusive int, reviewer string")
    assert abuse.reviewed(df, labels) == (["x"], [1])


def test_every_full_window_and_every_clause_is_scored_alike_in_text_and_alone(monkeypatch):
    rng = random.Random(3)
    words = ["今天外資又倒貨", "，", " ", "\n", "sell it now", "！", "看好", "x", "…", "跌"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["甲乙" * 60_000, " ", "\n，", "短"]
    reader, scorer, memory = abuse.Reader([]), gru.Scorer(gru.initial(3)), abuse.Memory()
    texts = reader.normal(texts)
    monkeypatch.setattr(abuse, "LOOK", 0.0)  # with no bound on scores all windows are looked at
    codes, starts, sizes, owner, _ = abuse.window_places(texts)
    joined = "\0".join(texts) + "\0"
    windows = [joined[a : a + n] for a, n in zip(starts, sizes)]
    assert all(w and w == w.strip() and "\0" not in w and len(w) <= abuse.WIDTH for w in windows)
    for i, text in enumerate(texts):
        mine = {w for w, o in zip(windows, owner) if o == i}
        full = {text[j : j + abuse.WIDTH].rstrip() for j in range(len(text) - abuse.WIDTH + 1) if not text[j].isspace()}
        clauses = {text[j : j + abuse.WIDTH].rstrip() for j in range(len(text)) if not text[j].isspace() and (j == 0 or (abuse._BREAKS.match(text[j - 1]) and not abuse._BREAKS.match(text[j])))}
        assert full <= mine and {c for c in clauses if len(c) > 1} <= mine
    alone = scorer(abuse.coded(list(dict.fromkeys(windows))))
    by = dict(zip(dict.fromkeys(windows), alone))
    got = abuse.row_scores(texts, reader, scorer, memory)
    want = [max((by[w] for w, o in zip(windows, owner) if o == i), default=0.0) for i in range(len(texts))]
    assert np.allclose(got, want, atol=1e-5)
    assert np.allclose(abuse.row_scores(texts, reader, scorer, memory), want, atol=1e-5)  # from memory
    assert np.allclose(abuse.row_scores(texts, reader, scorer, abuse.Memory(50)), want, atol=1e-5)


def test_no_window_is_left_out_for_its_neighbours_scores():
    at_its_place = lambda codes: (codes[:, 5] == ord("惡")).astype(np.float32)
    rng = random.Random(4)
    for place in range(5, 45):
        text = "".join(chr(0x5000 + rng.randrange(900)) for _ in range(64))
        text = text[:place] + "惡" + text[place + 1 :]
        assert abuse.row_scores(["平安", text, None], abuse.Reader([]), at_its_place, abuse.Memory()).tolist() == [0, 1, 0], place


def test_shared_states_give_what_training_gives():
    rng = random.Random(6)
    words = ["今天外資又倒貨", "，", "sell it now", "看好", "x", "跌"]
    windows = ["".join(rng.choice(words) for _ in range(rng.randint(0, 9)))[: rng.randint(1, abuse.WIDTH)] for _ in range(500)] + [""]
    p = gru.initial(3)
    p = {k: v * 3 for k, v in p.items()}
    codes = abuse.coded(windows)
    chars, ids = gru.features(codes)
    x = p["Ec"][chars] + p["Ew"][ids]
    s = np.concatenate([gru._run(x @ p[f"W{d}"] + p[f"b{d}"], p[f"U{d}"], d == "b")[0] for d in "fb"], 2)
    e = np.exp(np.where(chars > 0, np.tanh(s @ p["Wa"]) @ p["va"], -1e9))
    e[~(chars > 0).any(1), 0] = 1
    want = gru._sigmoid(((e / e.sum(1, keepdims=True))[:, :, None] * s).sum(1) @ p["wo"] + p["bo"])
    scorer = gru.Scorer(p)
    assert np.allclose(scorer(codes), want, atol=1e-5)
    scorer.MOST, scorer.BLOCK = 60, 7
    assert np.allclose(scorer(codes), want, atol=1e-5)


def test_memory_keeps_its_scores():
    rng = np.random.default_rng(2)
    memory, all_keys = abuse.Memory(), rng.permutation(np.arange(1, 40_000, dtype=np.uint64) * np.uint64(7919))
    for part in np.array_split(all_keys, 60):
        part = np.sort(part)
        assert not memory.known(part)[1].any()
        memory.add(part, (part % np.uint64(97)).astype(np.float32))
    scores, there = memory.known(all_keys)
    assert there.all() and (scores == all_keys % np.uint64(97)).all() and len(memory) == len(all_keys)
    assert not memory.known(all_keys + np.uint64(1))[1].any()


def test_a_worker_scores_equal_windows_once_over_the_tasks_of_a_query(monkeypatch):
    class Frame:  # hands out the function that every task unpickles for itself
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return pickle.dumps(run)

    scored = []
    call = gru.Scorer.__call__
    monkeypatch.setattr(gru.Scorer, "__call__", lambda self, codes: scored.append(len(codes)) or call(self, codes))
    texts = ["".join(chr(0x5000 + i + j) for i in range(60)) for j in range(0, 300, 100)]
    batch = pa.RecordBatch.from_pydict({"src": ["c"] * 3, "row_id": [1, 2, 3], "source": ["s"] * 3, "text": texts})
    params = gru.initial(3)
    task = lambda query: [s for out in pickle.loads(query)(iter([batch])) for s in out.column(3).to_pylist()]
    query = abuse.scored(Frame(), params, [])
    first = task(query)
    assert sum(scored) == 3 * 37
    assert task(query) == first and sum(scored) == 3 * 37
    assert task(abuse.scored(Frame(), params, [])) == first and sum(scored) == 6 * 37  # another query scores for itself


def test_characters_that_no_rule_changes_are_noted_once():
    reader = abuse.Reader(["蓼苔重工"])
    texts = ["今天ＡＢ外資，𠮷\0x", "今天蓼苔重工 1,234%", "퟿", ""]
    plain = str.maketrans({k: v for k, v in reader.table.items() if k != v})
    assert ord("今") not in reader.table
    want = ["今天ab外資,𠮷x", "今天甲 0", "퟿", ""]
    assert reader.normal(texts) == want == reader.normal(texts)
    assert reader.table[ord("今")] == ord("今") and all(t.translate(plain) == t.translate(reader.table) for t in texts)
