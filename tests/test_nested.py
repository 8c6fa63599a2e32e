import json
import random

from pyspark.sql import functions as F

from tidemark.operators import nested as N


def raw(spark, payloads):
    return spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "record_id bigint, payload string, body string")


def found(spark, payloads):
    df = raw(spark, payloads)
    rows = N.target_rows(N.shred(df, "raw", F.col("record_id"), F.col("payload"))).collect()
    return sorted((r.record_id, r.parent_pos, r.comment_pos, r.target_pos, r.target_text) for r in rows)


def test_shapes_of_comments_and_targets(spark):
    c = lambda pos, t, **k: {"pos": pos, "stock_targets": t, **k}
    payloads = [
        json.dumps({"comments": [c(0, ["a", "", None, {}, 5, {"k": "v"}]), c(1, "b"), c(2, {"o": ""}), c(3, None), c(4, 7)]}),
        json.dumps({"comments": {"0": {"stock_targets": ["x"]}, "3": {"analysis": {"stock_targets": ["y"]}}}}),
        json.dumps({"comments": json.dumps([c(0, ["z"])])}),
        json.dumps({"batches": [{"comments": [c(0, ["p"])]}, {"comments": None}, {"comments": [c(5, ["q"])]}]}),
        json.dumps({"comments": [c(0, [], replies=[c(1, ["r"], replies=[c(2, ["s", {"t": 1, "a": 2}])])])]}),
        json.dumps({"paragraph_stock_targets": {"1": "n", "2": "m"}}),
        json.dumps({"paragraph_stock_targets": [{"3": "n"}, {"4": "m"}], "comments": []}),
        None, "", "not json", "[]", '"text"', "5", "{}", '{"comments": [NaN]}', '{"comments": 5, "paragraph_stock_targets": null}', '{"comments": [null, 3, "x", []]}',
        json.dumps({"comments": [c(0, ["\ud83d"]), c(1, ["長" * 50_000])]}), "[" * 100_000,
    ]
    got = found(spark, payloads)
    assert [r[1:] for r in got if r[0] == 0] == [(-1, 0, 0, "a"), (-1, 0, 4, "5"), (-1, 0, 5, "k"), (-1, 1, 0, "b"), (-1, 2, 0, "o"), (-1, 4, 0, "7")]
    assert [r[1:] for r in got if r[0] == 1] == [(-1, 0, 0, "x"), (-1, 3, 0, "y")]
    assert [r[1:] for r in got if r[0] in (2, 3)] == [(-1, 0, 0, "z"), (-1, 0, 0, "p"), (-1, 5, 0, "q")]
    assert [r[1:] for r in got if r[0] == 4] == [(0, 1, 0, "r"), (1, 2, 0, "s"), (1, 2, 1, "t")]
    assert [r[1:] for r in got if r[0] in (5, 6)] == [(-1, -1, -1, c) for c in "1234"]
    assert {r[0] for r in got if 7 <= r[0] <= 16} == set()
    assert [r[4] for r in got if r[0] == 17] == ["�", "長" * 50_000] and {r[0] for r in got} <= set(range(18))


def rebuilt(bodies, ident):
    body = json.loads(bodies[ident])
    if "value" in body:
        return body["value"]
    return {"scalars": body["scalars"], "children": sorted(([f, o, rebuilt(bodies, i)] for f, o, i in body["children"]), key=json.dumps)}


def plain(node):
    return node.value if node.scalars is None else {"scalars": node.scalars, "children": sorted(([c.field, c.ordinal, plain(c)] for c in node.children), key=json.dumps)}


def test_identities_round_trip_and_store_once(spark):
    rng = random.Random(4)

    def value(depth):
        return {rng.choice("abc"): rng.choice([1, "x", None, [1, {"y": 2}], [[{"z": 1}]]]) if depth == 0 or rng.random() < 0.4 else value(depth - 1) for _ in range(rng.randint(0, 3))}

    payloads = [json.dumps(value(4)) for _ in range(60)] * 2
    sh = N.shred(raw(spark, payloads), "raw", F.col("record_id"), F.col("payload"), N.generic_tree).cache()
    store = N.objects(sh).collect()
    bodies = {r.object_id: r.body for r in store}
    assert len(bodies) == len(store) and len(set(bodies.values())) == len(store)
    roots = {r.record_id: r.object_id for r in N.bridges(sh).where("parent_occurrence = -1").collect()}
    for i, p in enumerate(payloads):
        assert rebuilt(bodies, roots[i]) == plain(N.generic_tree(json.loads(p)))
        assert roots[i] == roots[(i + 60) % 120]
    links = {(r.record_id, r.occurrence) for r in N.bridges(sh).collect()}
    assert all((r.record_id, r.parent_occurrence) in links for r in N.bridges(sh).where("parent_occurrence >= 0").collect())


def test_key_order_does_not_change_the_identity():
    a, b = ({"x": 1, "o": {"p": 1, "q": 2}}, {"o": {"q": 2, "p": 1}, "x": 1})
    ident = lambda v: N.identify(N.generic_tree(v))[0][3]
    assert ident(a) == ident(b) != ident({"x": 2, "o": {"p": 1, "q": 2}})


def test_comments_with_parents_and_empty_tables(spark):
    text = json.dumps({"comments": [{"pos": 0, "comment": "a", "commenter": "u", "comment_score": 1, "replies": [{"pos": 4, "comment": "b"}]}]})
    sh = N.shred(raw(spark, [text, text]), "raw", F.col("record_id"), F.col("payload"))
    rows = sorted((r.record_id, r.parent_pos, r.comment_pos, r.comment, r.commenter, r.comment_score) for r in N.comment_rows(sh).collect())
    assert rows == [(0, -1, 0, "a", "u", 1), (0, 0, 4, "b", None, None), (1, -1, 0, "a", "u", 1), (1, 0, 4, "b", None, None)]
    none = N.shred(raw(spark, ["x"]).limit(0), "raw", F.col("record_id"), F.col("payload"))
    assert N.target_rows(none).count() == N.comment_rows(none).count() == N.objects(none).count() == 0


def test_targets_of_typed_articles(spark):
    schema = "id bigint, paragraph_link string, paragraph_title string, comments array<struct<comment:string,pos:int,stock_targets:string>>, paragraph_stock_targets map<string,string>"
    rows = [(1, "l", "t", [("c", 7, '["a", {"b": "c"}]'), ("d", 8, '"x"'), ("e", 9, "bad json"), ("f", 10, None)], {"9": "n"}), (2, None, None, None, None), (3, "l", "t", [], {})]
    sh = N.shred_forum(spark.createDataFrame(rows, schema), spark.createDataFrame([], "record_id bigint, payload string"))
    got = sorted((r.record_id, r.comment_pos, r.target_pos, r.target_text) for r in N.target_rows(sh).collect())
    assert got == [(1, -1, -1, "9"), (1, 7, 0, "a"), (1, 7, 1, "b"), (1, 8, 0, "x")]


def test_batches_meta_and_unknown_fields_are_kept():
    a, b = {"pos": 0, "comment": "a"}, {"pos": 0, "comment": "b"}
    value = {
        "meta": {"footer": [{"ip": "1"}], "x": {"deep": [{"y": 1}]}}, "extra": {"comment": {"q": 1}},
        "batches": [{"batch_no": 1, "comments": [{**a, "odd": {"z": [2]}}]}, {"batch_no": 2, "comments": [b]}],
    }
    found = N.identify(N.forum_tree(value))
    assert sorted(n.scalars["batch_no"] for n, *_ in found if n.role == "batch") == [1, 2]
    assert {"meta", "footer", "x", "deep", "y", "extra", "odd", "z"} <= {n.field for n, *_ in found} | {k for n, *_ in found for k in n.scalars or {}}
    assert sum(n.role == "comment" for n, *_ in found) == 2
    places = [(parent, n.field, n.ordinal) for n, _, parent, *_ in found]
    assert len(places) == len(set(places))
    ident = lambda *batches: N.identify(N.forum_tree({"batches": [{"comments": x} for x in batches]}))[0][3]
    assert ident([a], [b]) != ident([b], [a])
    generic = lambda v: N.identify(N.generic_tree({"k": v}))[0][3]
    assert generic([[1], [2]]) != generic([[2], [1]])


def test_deep_replies_and_fields_are_walked_without_recursion(spark):
    def replies(depth):
        return "".join(f'{{"pos":{i},"stock_targets":["t"],"replies":[' for i in range(depth)) + "]}" * depth

    for depth in (500, 2000):
        tree = N.comment_nodes([{"pos": 0, "stock_targets": ["a"]}], "comments", -1, False)
        assert len(tree) == 1
        deep = {"pos": depth, "stock_targets": ["t"]}
        for i in range(depth - 1, -1, -1):
            deep = {"pos": i, "stock_targets": ["t"], "replies": [deep], "odd": {"x": [[1]]}}
        nodes, seen = N.comment_nodes([deep], "comments", -1, False), 0
        while nodes:
            assert nodes[0].comment_pos == seen and nodes[0].parent_pos == seen - 1
            seen += 1
            nodes = [n for n in nodes[0].children if n.role == "comment"]
        assert seen == depth + 1
    value = {"x": 1}
    for _ in range(50_000):
        value = {"child": value}
    assert len(N.identify(N.generic_tree(value))) == 50_001
    payloads = ['{"comments":[' + replies(d) + "]}" for d in (200, 2000, 100_000)] + ['{"comments":[{"pos":0,"stock_targets":["ok"]}]}']
    got = found(spark, payloads)
    assert [r for r in got if r[0] == 0] == [(0, i - 1, i, 0, "t") for i in range(200)]
    assert len([r for r in got if r[0] == 1]) in (0, 2000)  # as deep as the decoder reads
    assert not [r for r in got if r[0] == 2] and [r for r in got if r[0] == 3] == [(3, -1, 0, 0, "ok")]
