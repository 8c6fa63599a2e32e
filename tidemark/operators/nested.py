"""Deeply nested records to flat tables by Merkle subtree identities.

Every JSON object of a record becomes a node. Nodes are hashed bottom-up: the identity of a node is the hash of its
canonical body, in which children appear by their own identities, so two subtrees are equal exactly when their ids are.
``objects`` stores each distinct body once; ``bridges`` keeps every occurrence with its parent, field and ordinal.

Defined results for odd input: a null, empty or invalid payload gives no row, as does one that is no object. Text in
place of a list of comments is decoded first. Repeated keys in an object keep the last value. A lone surrogate becomes
U+FFFD. Replies and unknown fields may nest to any depth the decoder reads; a payload deeper than its limit, or with a
target too deep to be encoded again, counts as invalid. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import materialize

SCHEMA = (
    "src string, record_id bigint, occurrence int, parent_occurrence int, role string, field string, ordinal int, "
    "parent_pos int, comment_pos int, target_pos int, object_id string, value string, body string"
)
_ARROW = pa.schema(
    [
        ("src", pa.string()), ("record_id", pa.int64()), ("occurrence", pa.int32()), ("parent_occurrence", pa.int32()),
        ("role", pa.string()), ("field", pa.string()), ("ordinal", pa.int32()), ("parent_pos", pa.int32()),
        ("comment_pos", pa.int32()), ("target_pos", pa.int32()), ("object_id", pa.string()), ("value", pa.string()),
        ("body", pa.string()),
    ]
)
BRIDGE_COLUMNS = [f.name for f in _ARROW if f.name != "body"]
TARGET_ROLES = ("target", "article_target")
_ROWS_PER_BATCH = 20_000


@dataclass
class Node:
    """One object or scalar of a record: its own scalars, its children, and where it hangs."""

    role: str
    field: str
    ordinal: int
    scalars: dict[str, Any] | None
    value: str | None = None
    parent_pos: int = -1
    comment_pos: int = -1
    target_pos: int = -1
    children: list["Node"] = field(default_factory=list)


def _reject(token: str) -> None:
    raise ValueError(token)


def decode(text: str | None) -> Any:
    """The JSON value of a text, or None if it isn't valid JSON (NaN and Infinity aren't)."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


_canonical = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode
_LONE = re.compile("[\ud800-\udfff]")


def _clean(text: str) -> str:
    return _LONE.sub("\ufffd", text)


def scalar_text(value: Any) -> str:
    """A scalar as it is read: strings as they stand, the digits of a number, JSON's words for the rest."""
    return _clean(value) if isinstance(value, str) else json.dumps(value)


def generic_tree(value: Any, role: str = "record", name: str = "", ordinal: int = 0) -> Node | None:
    """The tree of any JSON object: nested objects and the elements of arrays become children."""
    if not isinstance(value, dict):
        return None
    node = Node(role, name, ordinal, {})
    for key, child in value.items():
        _generic_child(node, key, child)
    return node


def _generic_child(node: Node, key: str, child: Any) -> None:
    """Put a value below a node, with a stack instead of recursion, as input decides the depth."""
    todo: list[tuple[Node, str, Any, int, tuple[int, ...]]] = [(node, key, child, 0, ())]
    while todo:
        node, key, child, ordinal, path = todo.pop()
        if isinstance(child, dict):
            made = Node(key, key, ordinal, {})
            node.children.append(made)
            todo += [(made, k, v, 0, ()) for k, v in reversed(child.items())]
        elif isinstance(child, list):
            if not child and node.scalars is not None and not path:
                node.scalars[key] = []
            # A list in a list has its place in its name, so places stay different.
            todo += [(node, f"{key}[{i}]" if isinstance(item, list) else key, item, i, (*path, i)[-2:]) for i, item in reversed(list(enumerate(child)))]
        elif path:
            node.children.append(Node(key, key, ordinal, None, scalar_text(child)))
        elif node.scalars is not None:
            node.scalars[key] = child


def _as_int(value: Any) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return number if -(2**31) <= number < 2**31 else None


def _loose(key: str, child: Any) -> list[Node]:
    """The nodes of a nested field that no rule reads; they never pass for targets or comments."""
    holder = Node("", "", 0, {})
    _generic_child(holder, key, child)
    todo = list(holder.children)
    while todo:
        node = todo.pop()
        todo += node.children
        if node.role in (*TARGET_ROLES, "comment"):
            node.role = "nested"
    return holder.children


def target_nodes(targets: Any, parent_pos: int, comment_pos: int) -> list[Node]:
    """A node for each target: all elements are counted, null, "" and {} make none; a bare value is a list of one."""
    nodes = []
    for i, item in enumerate(targets if isinstance(targets, list) else [targets]):
        if item is None or item == "" or item == {}:
            continue
        if isinstance(item, dict):
            nodes.append(Node("target", "stock_targets", i, dict(item), None, parent_pos, comment_pos, i))
        elif isinstance(item, list):
            nodes += _loose(f"stock_targets[{i}]", item)
        else:
            nodes.append(Node("target", "stock_targets", i, None, scalar_text(item), parent_pos, comment_pos, i))
    return nodes


def comment_nodes(comments: Any, name: str, parent_pos: int, encoded: bool) -> list[Node]:
    """Comments of a list, of an object keyed by position, or of the text of either; replies nest below them, to any
    depth, so they are walked with a stack."""
    top: list[Node] = []
    todo: list[tuple[Any, str, int, list[Node]]] = [(comments, name, parent_pos, top)]
    joined: list[tuple[Node, list[Node], list[Node]]] = []
    while todo:
        value, name, parent, into = todo.pop()
        if isinstance(value, str):
            value = decode(value)
        entries = value.items() if isinstance(value, dict) else ((None, item) for item in value) if isinstance(value, list) else ()
        for i, (key, item) in enumerate(entries):
            if not isinstance(item, dict):
                continue
            node, known = _comment(key, item, name, i, parent, encoded)
            replies, rest = [], Node("", "", 0, {})
            _unknown(rest, item, known)
            todo.append((item.get("replies"), "replies", node.comment_pos, replies))
            joined.append((node, replies, rest.children))
            into.append(node)
    for node, replies, rest in joined:
        node.children += replies + rest
    return top


def _comment(key: str | None, item: dict, name: str, i: int, parent_pos: int, encoded: bool) -> tuple[Node, Sequence[str]]:
    """The node of one comment with its targets, and the fields that have rules of their own."""
    pos = _as_int(item.get("pos"))
    if pos is None:
        pos = _as_int(key) if key is not None else i
    pos = i if pos is None else pos
    analysis = item.get("analysis")
    known = ("stock_targets", "replies", *(["analysis"] if isinstance(analysis, dict) else []))
    node = Node("comment", name, i, _known_scalars(item, known), None, parent_pos, pos)
    targets = item.get("stock_targets")
    node.children += target_nodes(decode(targets) if encoded and isinstance(targets, str) else targets, parent_pos, pos)
    if isinstance(analysis, dict):
        own = "stock_targets" in item  # then those of the analysis aren't the comment's, and stay with it
        for made in _loose("analysis", {k: v for k, v in analysis.items() if own or k != "stock_targets"}):
            made.parent_pos, made.comment_pos = parent_pos, pos
            node.children.append(made)
        if not own:
            node.children += target_nodes(analysis.get("stock_targets"), parent_pos, pos)
    return node, known


def article_target_nodes(targets: Any) -> list[Node]:
    """Targets of the article: the keys of an object, or of each object of a list."""
    nodes = []
    for item in targets if isinstance(targets, list) else [targets]:
        if isinstance(item, dict):
            for code, name in item.items():
                nodes.append(Node("article_target", "paragraph_stock_targets", len(nodes), {code: name}))
        elif isinstance(item, (str, int)) and not isinstance(item, bool) and item != "":
            nodes.append(Node("article_target", "paragraph_stock_targets", len(nodes), None, scalar_text(item)))
    return nodes


def _unknown(node: Node, fields: dict, known: Sequence[str]) -> None:
    """The nested fields of an object that have no rule of their own, as nodes of the generic tree."""
    for key, child in fields.items():
        if key not in known and isinstance(child, (dict, list)):
            node.children += _loose(key, child)


def _known_scalars(fields: dict, known: Sequence[str]) -> dict[str, Any]:
    return {k: v for k, v in fields.items() if k not in known and (not isinstance(v, (dict, list)) or v == [])}


def forum_tree(value: Any, encoded: bool = False) -> Node | None:
    """The tree of one crawled article. ``encoded``: targets of comments are JSON text inside the JSON.
    Batches and the meta object are nodes of their own, so a comment hangs under its batch."""
    if not isinstance(value, dict):
        return None
    batches = value.get("batches")
    known = ("comments", "paragraph_stock_targets", *(["batches"] if isinstance(batches, list) else []))
    node = Node("article", "", 0, _known_scalars(value, known))
    node.children += article_target_nodes(value.get("paragraph_stock_targets"))
    node.children += comment_nodes(value.get("comments"), "comments", -1, encoded)
    for i, item in enumerate(batches if isinstance(batches, list) else []):
        if isinstance(item, dict):
            batch = Node("batch", "batches", i, _known_scalars(item, ("comments",)))
            batch.children += comment_nodes(item.get("comments"), "comments", -1, encoded)
            _unknown(batch, item, ("comments",))
            node.children.append(batch)
        elif isinstance(item, list):
            node.children += _loose(f"batches[{i}]", item)
    _unknown(node, value, known)
    return node


def identify(root: Node) -> list[tuple[Node, int, int, str, str]]:
    """(node, occurrence, parent occurrence, object id, canonical body), ids made bottom-up, occurrences top-down."""
    order: list[tuple[Node, int]] = [(root, -1)]
    at = 0
    while at < len(order):
        order += [(child, at) for child in order[at][0].children]
        at += 1
    refs: list[list[list[Any]]] = [[] for _ in order]
    made: list[tuple[str, str]] = [("", "")] * len(order)
    for i in range(len(order) - 1, -1, -1):
        node, parent = order[i]
        if node.scalars is None:
            body = _canonical({"value": node.value})
        else:
            plain = {"scalars": node.scalars, "children": sorted(refs[i])}
            if node.role == "target":  # which pair comes first counts here, so it belongs to the identity
                plain["first"] = next(iter(node.scalars))
            body = _canonical(plain)
        body = _clean(body)
        made[i] = (hashlib.blake2b(body.encode(), digest_size=16).hexdigest(), body)
        if parent >= 0:
            refs[parent].append([node.field, node.ordinal, made[i][0]])
    return [(node, i, parent, *made[i]) for i, (node, parent) in enumerate(order)]


def _occurrences(text: str | None, tree: Callable[[Any], Node | None]) -> list[tuple[Node, int, int, str, str]]:
    try:
        root = tree(decode(text))
        return [] if root is None else identify(root)
    except RecursionError:  # an object inside a target that the encoder finds too deep
        return []


def shred(
    frame: DataFrame, src: str, record_id: Column, payload: Column, tree: Callable[[Any], Node | None] = forum_tree, roles: Sequence[str] | None = None
) -> DataFrame:
    """All occurrences of all objects in the payloads, one map-only pass. The body is given once per batch and id.
    ``roles``: only occurrences of these leave Python (identities are still made of whole subtrees)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        seen: set[str] = set()
        for batch in batches:
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for node, at, parent, ident, body in _occurrences(text, tree):
                    if roles is not None and node.role not in roles:
                        continue
                    first = ident not in seen
                    seen.add(ident)
                    out.append((src, record, at, parent, node.role, node.field, node.ordinal, node.parent_pos, node.comment_pos, node.target_pos, ident, node.value, body if first else None))
                if len(out) >= _ROWS_PER_BATCH:
                    yield _batch(out)
                    out = []
                    seen.clear()
        if out:
            yield _batch(out)

    return frame.select(record_id.alias("record_id"), payload.alias("payload")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def objects(shredded: DataFrame) -> DataFrame:
    """Each distinct object once. Bodies come once per batch, so little is left for the shuffle to combine."""
    return shredded.where(F.col("body").isNotNull()).groupBy("object_id").agg(F.min("body").alias("body"))


def bridges(shredded: DataFrame) -> DataFrame:
    """Every occurrence with its parent occurrence, field, ordinal and object id."""
    return shredded.select(*BRIDGE_COLUMNS)


def resolve(occurrences: DataFrame, store: DataFrame, salts: int = 8) -> DataFrame:
    """Give occurrences the body of their object. Identical objects make hot ids, so both sides carry a salt."""
    salted = occurrences.withColumn("_salt", F.pmod(F.xxhash64("record_id", "occurrence"), F.lit(salts)).cast("int"))
    spread = store.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(spread, ["object_id", "_salt"], "left").drop("_salt")


def target_rows(shredded: DataFrame) -> DataFrame:
    """One row per stock target with the keys of comment and parent comment. All texts, those of scalars too, come from
    the object store: they are read from each distinct body once and joined to the occurrences."""
    # Used twice below: written once, so payloads are parsed once.
    shredded = materialize(shredded.where(F.col("role").isin(*TARGET_ROLES)))
    body = F.col("body")
    first = F.coalesce(F.get_json_object(body, "$.first"), F.map_keys(F.from_json(F.get_json_object(body, "$.scalars"), "map<string,string>"))[0])
    store = objects(shredded).select("object_id", F.coalesce(F.get_json_object(body, "$.value"), first).alias("target_text"))
    return resolve(bridges(shredded), store).select("src", "record_id", "parent_pos", "comment_pos", "target_pos", "target_text")


def comment_rows(shredded: DataFrame) -> DataFrame:
    """Flat comments with parent keys, fields read from the object store."""
    shredded = materialize(shredded.where(F.col("role") == "comment"))
    full = resolve(bridges(shredded), objects(shredded))
    field_of = lambda name: F.get_json_object("body", f"$.scalars.{name}")
    return full.select(
        "src", "record_id", "occurrence", "parent_occurrence", "parent_pos", "comment_pos", "ordinal", "object_id",
        field_of("commenter").alias("commenter"), field_of("comment").alias("comment"),
        field_of("comment_score").cast("int").alias("comment_score"), field_of("comment_time").alias("comment_time"),
    )


def shred_forum(articles: DataFrame, raw_records: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """Occurrences of both nested sources of the forum in one frame."""
    body = F.to_json(F.struct(*[c for c in articles.columns if c != "id"]))
    typed = shred(articles, "articles", F.col("id"), body, lambda value: forum_tree(value, encoded=True), roles)
    raw = shred(raw_records, "raw_records", F.col("record_id"), F.col("payload"), roles=roles)
    return typed.unionByName(raw)
