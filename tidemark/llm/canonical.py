"""Freely typed values to the entries of a reference list (problem 5).

A prefix-filter set-similarity join: each reading of a value and each entry is a set of tokens (characters with their
count, and pairs of neighbours with both ends marked). Tokens are ordered by rarity over both sides; sets that reach the
threshold share one of their rare prefix tokens, so only prefixes are joined. Length and positional filters follow, then
the exact Jaccard similarity, and the best entry is kept.

Entries are of four kinds: names (similarity ``THRESHOLD``), codes, nicknames, and nicknames without regard to case (all
three: equal after cleaning). A value has a reading of each kind. Preferred are, in order: equal codes, equal names, equal
nicknames, nicknames that differ in case, similar names. Among equals the entry that is named by its code most often in
the whole column wins, then the smaller code.

Defined results: null, "" and {} give no row; an invalid list gives none; a value that matches nothing gets ''. Entries
without a name take part by code only. Empty lists or an empty reference table are fine.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.collections import json_items
from tidemark.functions.distance import within_one_edit
from tidemark.llm.forms import fold
from tidemark.session import materialize

THRESHOLD = 0.4
#: A similar name must also be reachable by so many edits.
MAX_EDITS = 1
#: Two-character names have SHORT tokens; swapped they keep two of eight, so they are joined at a lower threshold, and
#: only swaps count.
SHORT, SHORT_THRESHOLD = 5, 0.25
CODE, NAME, NICKNAME, NICKNAME_FOLDED = "code", "name", "nickname", "nickname_folded"

# Words round a name or code, particles after one.
_COMPANY = ("股份有限公司", "有限公司", "公司")
_PARTICLES = "啦吧喔啊耶呢哦囉"
_CODE = re.compile(r"(?<![0-9A-Za-z.])([0-9Oo]{4,6}[A-Za-z]?)(?![0-9A-Za-z])")
_TRIM = re.compile(r"^[\W_]+|[^\w+]+$")
_LOOSE = re.compile(r"[\s\-_.·]+")
_fold = lru_cache(70_000)(fold)
#: The blocks whose characters have simplified forms.
_IDEOGRAPHS = range(0x3400, 0xA000)


def simplified(spark: SparkSession) -> dict[int, str]:
    """The simplified form of each ideograph that has one, by the public transliteration rules that come with Spark (the
    ICU library). Both sides are read in simplified form, as several traditional characters may share one. The table has
    about 3,000 entries, whatever the input."""
    rules = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    chars = [chr(c) for c in _IDEOGRAPHS]
    return {ord(a): b for a, b in zip(chars, rules.transliterate("\n".join(chars)).split("\n")) if a != b and len(b) == 1}


def typed_values(comments: DataFrame) -> DataFrame:
    """(comment_id, target_pos, value, other) of each element; ``other`` is the value of an object's first pair."""
    flat = comments.select("comment_id", F.posexplode(json_items(F.col("stock_targets"))).alias("target_pos", "item"))
    flat = flat.where("item is not null and item <> ''")
    pair = F.when(F.col("item").startswith("{"), F.from_json("item", "map<string,string>"))
    flat = flat.withColumn("pair", pair).where("pair is null or size(pair) > 0")
    return flat.select(
        "comment_id", "target_pos", F.coalesce(F.get(F.map_keys("pair"), F.lit(0)), "item").alias("value"), F.get(F.map_values("pair"), F.lit(0)).alias("other")
    )


def _plain(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(map(_fold, text))).strip()


def name_reading(text: str) -> str:
    """A name without case, spaces, hyphens, marks at its ends and company words."""
    text = _LOOSE.sub("", _TRIM.sub("", _plain(text))).upper()
    for word in _COMPANY:
        if len(text) > len(word) and text.endswith(word):
            return text[: -len(word)]
    return text


def nickname_reading(text: str) -> str:
    return re.sub(r"\s+", "", _TRIM.sub("", _plain(text)))


def readings(value: str) -> list[tuple[str, str]]:
    """(kind, reading) of what a typed value may mean."""
    plain = _plain(value)
    out = []
    code = _CODE.search(plain)
    rest = plain
    if code and sum(c.isdigit() for c in code.group(1)) >= 2:
        text = code.group(1).upper()
        out.append((CODE, text[:-1].replace("O", "0") + (text[-1] if len(text) > 4 and text[-1] != "O" else text[-1].replace("O", "0"))))
        rest = plain[: code.start()] + " " + plain[code.end() :]
        rest = re.sub(r"代號|代号|號|号|\.TW\b", "", rest)
    else:
        joined = re.match(r"^[^0-9]{0,3}?([0-9]{4,6}[A-Z]?)([^0-9A-Za-z+].*)$", plain)
        if joined:
            out.append((CODE, joined.group(1)))
            rest = joined.group(2)
    name, nickname = name_reading(rest), nickname_reading(rest)
    for stem, reading in ((name, NAME), (nickname, NICKNAME)):
        for text in dict.fromkeys((stem, stem.rstrip(_PARTICLES))):
            if text:
                out.append((reading, text))
                if reading == NICKNAME:
                    out.append((NICKNAME_FOLDED, text.upper()))
    return list(dict.fromkeys(out))


def tokens(text: str) -> list[str]:
    """Characters with how often they came before, and neighbours, the ends marked."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        out.append(f"{c}{seen[c]}")
    ends = f"\x02{text}\x03"
    return sorted(set(out) | {ends[i : i + 2] for i in range(len(ends) - 1)})


def _value_rows(table: dict[int, str]):
    # Folded before simplified: a compatibility form isn't in the table, what it folds to may be.
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, n, kind, text, tokens(text)) for v, n in zip(pdf["value"], pdf["n"]) for kind, text in readings(_plain(v).translate(table))]
            yield pd.DataFrame(rows, columns=["value", "n", "kind", "reading", "tokens"])

    return run


def _entry_rows(table: dict[int, str]):
    make = {CODE: lambda t: t.strip().upper(), NAME: name_reading, NICKNAME: nickname_reading, NICKNAME_FOLDED: lambda t: nickname_reading(t).upper()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(no, kind, make[kind](_plain(text).translate(table))) for no, kind, text in zip(pdf["stock_no"], pdf["kind"], pdf["text"])]
            yield pd.DataFrame([(no, kind, text, tokens(text)) for no, kind, text in made if text], columns=["stock_no", "kind", "entry", "tokens"])

    return run


def entries(targets: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(stock_no, kind, text) of the reference list."""
    known = targets.where("stock_no is not null").select("stock_no", "stock_name")
    codes = known.select("stock_no", F.lit(CODE).alias("kind"), F.col("stock_no").alias("text"))
    names = known.select("stock_no", F.lit(NAME).alias("kind"), F.col("stock_name").alias("text"))
    nicks = nicknames.join(known.select("stock_no").distinct(), "stock_no", "left_semi").select("stock_no", F.lit(NICKNAME).alias("kind"), F.col("stock_nickname").alias("text"))
    loose = nicks.withColumn("kind", F.lit(NICKNAME_FOLDED))
    return codes.unionByName(names).unionByName(nicks).unionByName(loose).where("text is not null and text <> ''").distinct()


def _prefixes(sets: DataFrame, keys: list[str], rarity: DataFrame, threshold: float) -> DataFrame:
    """keys, kind, size, token, at: the rare prefix of each set. A threshold of 1 needs one token only."""
    ranked = sets.select(*keys, "kind", F.explode("tokens").alias("token")).join(rarity, "token")
    ordered = ranked.groupBy(*keys, "kind").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    size = F.size("t")
    least = F.when(size <= SHORT, SHORT_THRESHOLD).otherwise(threshold)
    length = F.when(F.col("kind") == NAME, size - F.ceil(size * least - 1e-9) + 1).otherwise(1)
    return ordered.select(*keys, "kind", size.alias("size"), F.posexplode(F.slice("t", 1, length)).alias("at", "p")).select(*keys, "kind", "size", "at", F.col("p.token").alias("token"))


def similar(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(value, n, kind, reading, stock_no, entry, jaccard) of all pairs that reach their kind's threshold.

    values: (value, n, kind, reading, tokens); reference: (stock_no, kind, entry, tokens).
    """
    sets = values.select("kind", "reading", "tokens").dropDuplicates(["kind", "reading"])
    listed = reference.select("kind", "entry", "tokens").dropDuplicates(["kind", "entry"])
    rarity = sets.select(F.explode("tokens").alias("token")).unionByName(listed.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))
    x = _prefixes(sets, ["reading"], rarity, threshold)
    y = _prefixes(listed, ["entry"], rarity, threshold).withColumnsRenamed({"size": "size_y", "at": "at_y"})
    pairs = x.join(y, ["kind", "token"])
    short = (F.col("size") <= SHORT) & (F.col("size_y") <= SHORT)
    t = F.when(F.col("kind") == NAME, F.when(short, SHORT_THRESHOLD).otherwise(threshold)).otherwise(1.0)
    need = F.ceil(t / (1 + t) * (F.col("size") + F.col("size_y")) - 1e-9)
    pairs = pairs.where((F.least("size", "size_y") >= t * F.greatest("size", "size_y") - 1e-9) & (1 + F.least(F.col("size") - F.col("at") - 1, F.col("size_y") - F.col("at_y") - 1) >= need))
    pairs = pairs.select("kind", "reading", "entry").distinct()
    pairs = pairs.join(sets, ["kind", "reading"]).join(listed.withColumnRenamed("tokens", "tokens_y"), ["kind", "entry"])
    both = F.size(F.array_intersect("tokens", "tokens_y"))
    jaccard = both / (F.size("tokens") + F.size("tokens_y") - both)
    swapped = (F.size("tokens") <= SHORT) & (F.size("tokens_y") <= SHORT) & (F.array_sort(F.split("reading", "")) == F.array_sort(F.split("entry", "")))
    exact = F.when(F.col("kind") == NAME, (jaccard >= threshold - 1e-9) | swapped).otherwise(F.col("reading") == F.col("entry"))
    pairs = pairs.where(exact).select("kind", "reading", "entry", jaccard.alias("jaccard"))
    # All that counts below is whether there are none, one or more edits.
    edits = F.when(F.col("reading") == F.col("entry"), 0).when(within_one_edit(F.col("reading"), F.col("entry")), 1).otherwise(2)
    pairs = pairs.withColumn("edits", edits)
    return values.select("value", "n", "kind", "reading").join(pairs, ["kind", "reading"]).join(reference.select("stock_no", "kind", "entry"), ["kind", "entry"])


def matched(counted: DataFrame, targets: DataFrame, nicknames: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(value, n) to (value, stock_no) of the values that stand for a stock."""
    table = simplified(counted.sparkSession)
    # Both sides and the pairs are used several times; without a cut each use would repeat the work before it.
    values = materialize(counted.mapInPandas(_value_rows(table), "value string, n bigint, kind string, reading string, tokens array<string>"))
    reference = materialize(entries(targets, nicknames).mapInPandas(_entry_rows(table), "stock_no string, kind string, entry string, tokens array<string>"))
    pairs = materialize(similar(values, reference, threshold).where((F.col("kind") != NAME) | (F.col("edits") <= MAX_EDITS)))
    named = pairs.where(F.col("kind") == CODE).groupBy("stock_no").agg(F.sum("n").alias("named"))
    level = (
        F.when(F.col("kind") == CODE, 5)
        .when((F.col("kind") == NAME) & (F.col("edits") == 0), 4)
        .when(F.col("kind") == NICKNAME, 3)
        .when(F.col("kind") == NICKNAME_FOLDED, 2)
        .otherwise(1)
    )
    rated = pairs.join(named, "stock_no", "left").select(
        "value", "stock_no", F.struct(level.alias("level"), F.col("jaccard"), F.coalesce("named", F.lit(0)).alias("named")).alias("rate")
    )
    best = rated.groupBy("value").agg(F.max("rate").alias("rate"))
    return rated.join(best, ["value", "rate"]).groupBy("value").agg(F.min("stock_no").alias("stock_no"))


def resolved(comments: DataFrame, targets: DataFrame, nicknames: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(comment_id, target_pos, stock_no): each typed element with its code, '' if it stands for none."""
    typed = typed_values(comments)
    counted = typed.select(F.explode(F.array("value", "other")).alias("value")).where("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    known = materialize(matched(counted, targets, nicknames, threshold))
    # Values without a second reading take their first again, so that no task gets all rows that have none.
    typed = typed.withColumn("other", F.coalesce("other", "value"))
    first = typed.join(known, "value", "left").withColumnRenamed("stock_no", "by_value")
    both = first.join(known.withColumnsRenamed({"value": "other", "stock_no": "by_other"}), "other", "left")
    return both.select("comment_id", "target_pos", F.coalesce("by_value", "by_other", F.lit("")).alias("stock_no"))


def unmatched(comments: DataFrame, targets: DataFrame, nicknames: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The typed values that stand for nothing, and how often each was typed."""
    counted = typed_values(comments).groupBy("value").agg(F.count("*").alias("n"))
    return counted.where("value <> ''").join(matched(counted.where("value <> ''"), targets, nicknames, threshold), "value", "left_anti")
