"""One consistent form for texts that look the same (problem 4).

Texts are exploded to positioned code points, joined with a broadcast table of decompositions and look-alikes, and
rebuilt from the positions that change. Texts that hold combining marks take the full way: all their code points, marks
ordered by combining class within each base's cluster, then recomposed.

The table is built by rule from the Unicode data of Python; its size is that of a fixed part of Unicode (3,178 rows),
whatever the input. Folded are: full- and half-width forms, spaces other than U+0020, radicals and compatibility
ideographs, canonical equivalents, invisible format characters, and the look-alike letters listed below. Case, digits,
visible accents and other words stay as they are. Line ends stay as they are.

Two forms come out: ``form``, equal for all texts that look equal, is for comparisons; ``shown`` is for reading and differs
in one thing: a look-alike letter stays beside a letter of its own script (the long vowel of a Japanese word isn't the
ideograph for one, though it looks like it).

Defined results: a null text has null forms; an empty text empty ones; a text of invisible characters only becomes
empty. Ties and repeated rows don't matter: each distinct text is worked on once and its form joined back.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from tidemark.session import materialize

# Look-alike letters and the letters they stand for, in order of script.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ѵ": "v",
    "օ": "o", "ս": "u", "ɑ": "a", "ɡ": "g", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
    "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "エ": "工", "オ": "才", "カ": "力", "タ": "夕", "ト": "卜", "ニ": "二", "ノ": "丿", "ハ": "八", "ロ": "口", "ー": "一",
    "ヘ": "へ", "‐": "-", "‑": "-", "‒": "-", "⁃": "-", "−": "-", "﹣": "-", "‧": "·", "∙": "·", "⋅": "·", "∶": ":",
    "∕": "/", "⁄": "/", "〜": "~", "∼": "~", "⋯": "…", "〇": "○", "◯": "○",
}

#: Stands after the last code point, so that every text has at least one joined position.
END = "\U0010ffff"
_RADICALS = range(0x2E80, 0x2FE0)
_KEPT_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}
_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


#: Scripts whose look-alikes stay beside letters of the same script in the form that is shown, with their code points.
SCRIPTS = {"kana": ((0x30A0, 0x30FF), (0xFF66, 0xFF9F)), "greek": ((0x0370, 0x03FF),), "cyrillic": ((0x0400, 0x052F),), "armenian": ((0x0530, 0x058F),)}


def own_form(ch: str) -> tuple[str, str]:
    """(script, form within it) of a letter that is or holds a look-alike of another script; two empty texts for others."""
    parts = _decomposed(ch)
    script = next((name for name, spans in SCRIPTS.items() for low, high in spans if parts[:1] in LOOKALIKES and low <= ord(parts[0]) <= high), "")
    return (script, unicodedata.normalize("NFC", parts)) if script else ("", "")


def _ignored(ch: str) -> bool:
    code = ord(ch)
    return code in _FILLERS or (unicodedata.category(ch) == "Cf" and code not in _KEPT_FORMATS and not 0xE0020 <= code <= 0xE007F)


def _decomposed(ch: str) -> str:
    if unicodedata.category(ch) == "Zs":
        return " "
    data = unicodedata.decomposition(ch)
    if not data:
        return ch
    parts = data.split()
    if parts[0].startswith("<"):
        single_compat = parts[0] == "<compat>" and len(parts) == 2 and ord(ch) in _RADICALS
        if parts[0] not in ("<wide>", "<narrow>", "<noBreak>") and not single_compat:
            return ch
        parts = parts[1:]
    return "".join(_decomposed(chr(int(p, 16))) for p in parts)


def fold(ch: str) -> str:
    """The form of one code point on its own."""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if _ignored(ch):
        return ""
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in _decomposed(ch) if not _ignored(c)))


@lru_cache(1)
def _rows() -> pa.Table:
    """(ch, repl, is_mark, ccc, script, own) of each code point that changes or that may combine with the one before it."""
    rows = [(END, "", False, 0, "", "")]
    seconds = set()
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
    for code in codes:
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(int(parts[1], 16))
    seconds |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for code in codes:
        ch = chr(code)
        if code < 0x80 or unicodedata.category(ch) in ("Cn", "Co"):
            continue
        folded, ccc = fold(ch), unicodedata.combining(ch)
        mark = (ccc > 0 or code in seconds) and folded != ""
        if mark or folded != ch:
            rows.append((ch, folded, mark, ccc, *own_form(ch)))
    cols = list(zip(*rows))
    return pa.table({"ch": pa.array(cols[0]), "repl": pa.array(cols[1]), "is_mark": pa.array(cols[2]), "ccc": pa.array(cols[3], pa.int32()), "script": pa.array(cols[4]), "own": pa.array(cols[5])})


def mapping(spark: SparkSession) -> DataFrame:
    """The table of folds; bounded by Unicode, so safe to broadcast."""
    return spark.createDataFrame(_rows())


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text in shuffles."""
    return F.unhex(F.md5(text))


def _code_points(text: Column) -> Column:
    return F.concat(F.split(text, ""), F.array(F.lit(END)))


def _spliced(text: str, edits: str) -> Column:
    """The text with each edit (pos, repl), in order of pos, put in the place of one code point."""
    return F.expr(
        f"array_join(transform({edits}, (e, i) -> concat(substring({text}, if(i = 0, 0, {edits}[i - 1].pos + 1) + 1, "
        f"e.pos - if(i = 0, 0, {edits}[i - 1].pos + 1)), e.repl)), '')"
    )


@F.pandas_udf(StringType())
def _recomposed(cluster: pd.Series) -> pd.Series:
    return cluster.map(lambda s: unicodedata.normalize("NFC", s))


def _of_script(ch: Column, name: Column) -> Column:
    """Is the code point one of the named script?"""
    code, found = F.ascii(ch), F.lit(False)
    for script, spans in SCRIPTS.items():
        for low, high in spans:
            found = found | ((name == script) & code.between(low, high))
    return F.coalesce(found, F.lit(False))


def _with_marks(texts: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """keys + form + shown, for texts that hold combining marks: clusters of a base and its ordered marks, recomposed."""
    points = texts.select(*keys, F.posexplode(F.split("text", "")).alias("pos", "ch"))
    ordered = "partition by " + ", ".join(keys) + " order by pos"
    points = points.withColumns({"before": F.expr(f"lag(ch) over ({ordered})"), "after": F.expr(f"lead(ch) over ({ordered})")})
    points = points.join(F.broadcast(table), "ch", "left")
    own = _of_script(F.col("before"), F.col("script")) | _of_script(F.col("after"), F.col("script"))
    points = points.select(
        *keys, "pos", F.coalesce("repl", "ch").alias("repl"), F.when(own, F.col("own")).otherwise(F.coalesce("repl", "ch")).alias("shown"),
        F.coalesce("is_mark", F.lit(False)).alias("is_mark"), F.coalesce("ccc", F.lit(0)).alias("ccc"),
    )
    starter = "(not is_mark and repl <> '')"
    points = points.withColumn("cluster", F.expr(f"sum(cast({starter} as int)) over ({ordered} rows unbounded preceding)"))
    points = points.withColumn("block", F.expr(f"sum(cast(ccc = 0 as int)) over ({ordered} rows unbounded preceding)"))
    clusters = points.groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(F.struct("block", "ccc", "pos", "repl", "shown"))).alias("p"))
    whole = lambda part: F.array_join(F.transform("p", lambda x: x[part]), "")
    made = lambda part: F.when(F.size("p") > 1, _recomposed(whole(part))).otherwise(whole(part))
    clusters = clusters.select(*keys, "cluster", made("repl").alias("s"), made("shown").alias("r"))
    back = lambda part: F.array_join(F.transform("all", lambda x: x[part]), "")
    return clusters.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "s", "r"))).alias("all")).select(*keys, back("s").alias("form"), back("r").alias("shown"))


def distinct_forms(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys + form + shown for texts (keys..., text) whose keys are unique and by which the frame is best partitioned."""
    table = mapping(texts.sparkSession)
    points = texts.select(*keys, F.posexplode(_code_points(F.col("text"))).alias("pos", "ch"))
    hits = points.join(F.broadcast(table), "ch").select(*keys, F.struct("pos", "repl", "script", "own").alias("edit"), "is_mark")
    edits = hits.groupBy(*keys).agg(F.array_sort(F.collect_list("edit")).alias("edits"), F.max("is_mark").alias("marks"))
    # Read by both branches below: written once, so texts are exploded once.
    full = materialize(texts.join(edits, keys))
    before = lambda e: (e["pos"] > 0) & _of_script(F.substring("text", e["pos"], F.lit(1)), e["script"])
    after = lambda e: _of_script(F.substring("text", e["pos"] + 2, F.lit(1)), e["script"])
    kept = F.transform("edits", lambda e: F.struct(e["pos"].alias("pos"), F.when(before(e) | after(e), e["own"]).otherwise(e["repl"]).alias("repl")))
    plain = full.where(~F.col("marks")).withColumn("kept", F.when(F.exists("edits", lambda e: e["script"] != ""), kept))
    plain = plain.withColumns({"form": _spliced("text", "edits"), "shown": F.when(F.col("kept").isNotNull(), _spliced("text", "kept"))})
    plain = plain.select(*keys, "form", F.coalesce("shown", "form").alias("shown"))
    return plain.unionByName(_with_marks(full.where("marks").select(*keys, "text"), table, keys))


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their text, and the different texts of each field."""
    keyed = rows.select("field_name", "id", "text").withColumn("k", text_key(F.col("text")))
    return keyed.select("field_name", "id", "k"), keyed.where("k is not null").groupBy("field_name", "k").agg(F.first("text").alias("text"))


def forms(rows: DataFrame) -> DataFrame:
    """(field_name, id, text) to (field_name, id, form, shown). A null text has null forms."""
    keyed, distinct = _distinct(rows)
    made = distinct_forms(distinct, ["field_name", "k"])
    # Rows without a text don't take part in the join, where all of them would meet in one task.
    none = keyed.where("k is null").select("field_name", "id", F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("shown"))
    return keyed.where("k is not null").join(made, ["field_name", "k"]).select("field_name", "id", "form", "shown").unionByName(none)


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field_name, f, k) of texts whose form another text has too, and (field_name, f, id, k) of their rows."""
    keyed, distinct = _distinct(rows)
    variants = materialize(distinct_forms(distinct, ["field_name", "k"]).select("field_name", "k", text_key(F.col("form")).alias("f")))
    groups = variants.groupBy("field_name", "f").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    texts = materialize(variants.join(groups, ["field_name", "f"]))
    return texts, materialize(keyed.join(texts, ["field_name", "k"]).select("field_name", "f", "id", "k"))


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """(field_name, id, text) to pairs of rows of one field with equal forms but different texts.

    Different texts of a form are paired first and then expanded to their rows, so equal texts never meet and the work is
    that of the result. Groups with one text only (most, however many rows they hold) are left out before.
    """
    texts, members = _classes(rows)
    side = lambda x: texts.select("field_name", "f", F.col("k").alias(f"k_{x}"))
    pairs = side("a").join(side("b"), ["field_name", "f"]).where("k_a < k_b").select("field_name", "k_a", "k_b")
    of = lambda x: members.select("field_name", F.col("k").alias(f"k_{x}"), F.col("id").alias(f"i_{x}"))
    found = pairs.join(of("a"), ["field_name", "k_a"]).join(of("b"), ["field_name", "k_b"])
    return found.select("field_name", F.least("i_a", "i_b").alias("id_a"), F.greatest("i_a", "i_b").alias("id_b")).where("id_a < id_b")


def lookalike_classes(rows: DataFrame) -> DataFrame:
    """(field_name, id, class_id, links): the rows that have a look-alike, one each, with the smallest id of their class
    and the number of rows that look the same but differ. Grows with the rows, not with their pairs."""
    texts, members = _classes(rows)
    per_text = members.groupBy("field_name", "f", "k").agg(F.count("*").alias("own"), F.min("id").alias("least"))
    per_form = per_text.groupBy("field_name", "f").agg(F.sum("own").alias("all"), F.min("least").alias("class_id"))
    known = per_text.join(per_form, ["field_name", "f"]).select("field_name", "k", "class_id", (F.col("all") - F.col("own")).alias("links"))
    return members.join(known, ["field_name", "k"]).select("field_name", "id", "class_id", "links")


def forum_texts(comments: DataFrame, articles: DataFrame) -> DataFrame:
    """The three fields of the forum as (field_name, id, text)."""
    one = lambda df, key, name: df.select(F.lit(name).alias("field_name"), F.col(key).alias("id"), F.col(name).alias("text"))
    return one(comments, "comment_id", "comment").unionByName(one(articles, "id", "paragraph_title")).unionByName(one(articles, "id", "paragraph_content"))
