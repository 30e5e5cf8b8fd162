"""Visually identical text in different characters, brought to one form.

Texts are exploded to positioned code points; a broadcast join gives each its full compatibility
decomposition with look-alike letters folded and invisible characters dropped; combining marks are put in
order by their class within each starter; starter and marks are recomposed by a second broadcast join; and
the strings are rebuilt. The tables come from the Unicode data of Python, so their size is bounded by
Unicode. All steps after the distinct run on one partitioning by text.

Defined results: NULL gives no row; a text of invisible characters only becomes empty; runs of blanks
become one ASCII blank, and blanks at the ends go. A starter with several marks that has no single
composed character stays decomposed, for every writing of it alike.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.tables import few, table

# Characters that look like the one at the same place of the second line.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝ"
AS_LATIN = "ABESIJKMHOPCTYXYGQWaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυ"
AS_LATIN_2 = "ABEZHIKMNOPTYXaikvopu"
# Katakana, Latin and box-like letters that look like Han characters.
KANA = "ロエカタトハニチオミ"
AS_HAN = "口工力夕卜八二千才三"
# CJK radicals of the supplement without a decomposition of their own.
RADICALS = "⺁⺃⺆⺈⺌⺗⺟⻁⻄⻅⻆⻈⻉⻋⻌⻑⻒⻓⻔⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻯⻰⻳⻲"
AS_HAN_2 = "厂乚冂刀小心母虎西见角讠贝车辶長镸长门雨青韦页风飞食饣首马骨鬼鱼鸟卤麦黄黾齐齿竜龙龟龜"
HAN_FORMS = "靑戶產"
AS_HAN_3 = "青户产"
DOTS = "・‧•∙⋅･᛫․●ㆍ"
DASHES = "‐‑‒–—―−﹘⁃"
QUOTES = "’‘‛ʼʻˈ′`´＇"
DOUBLE_QUOTES = "“”„‟″"
LEFT, RIGHT = "（﹙﹝〔❨❲⟮⦅", "）﹚﹞〕❩❳⟯⦆"
ANGLES_LEFT, ANGLES_RIGHT = "《≪", "》≫"


@lru_cache(maxsize=1)
def fold_table() -> dict[str, str]:
    out: dict[str, str] = {}
    for a, b in ((CYRILLIC, AS_LATIN), (GREEK, AS_LATIN_2), (KANA, AS_HAN), (RADICALS, AS_HAN_2), (HAN_FORMS, AS_HAN_3)):
        out.update(zip(a, b, strict=True))
    out.update(zip("ıɑɡ⁄∕∶", "iag//:", strict=True))
    for group, one in ((DOTS, "·"), (DASHES, "-"), (QUOTES, "'"), (DOUBLE_QUOTES, '"'), (LEFT, "("), (RIGHT, ")"), (ANGLES_LEFT, "«"), (ANGLES_RIGHT, "»")):
        out.update(dict.fromkeys(group, one))
    return out


def invisible(ch: str) -> bool:
    return unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace() or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠏"


def parts_of(ch: str) -> str:
    """The folded full decomposition of one character; '' if it is invisible."""
    fold = fold_table()
    if invisible(ch):
        return ""
    if ch.isspace():
        return " "
    if ch in fold and not unicodedata.decomposition(ch):
        return fold[ch]
    return "".join(" " if c.isspace() else fold.get(c, c) for c in unicodedata.normalize("NFKD", fold.get(ch, ch)) if not invisible(c))


@lru_cache(maxsize=1)
def tables_() -> tuple[list, list]:
    """(character, its parts and their combining classes), (sequence, composed)."""
    decomposed, composed = [], {}
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            continue
        parts = parts_of(ch)
        if parts != ch or unicodedata.combining(ch):
            decomposed.append((ch, [(c, unicodedata.combining(c)) for c in parts]))
        own = unicodedata.normalize("NFD", ch)
        if len(own) > 1 and unicodedata.combining(own[1]) and unicodedata.normalize("NFC", own) == ch:
            seq = "".join(map(parts_of, own))
            if seq == own or seq not in composed:
                composed[seq] = ch
    return decomposed, sorted(composed.items())


def _map_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    decomposed, composed = tables_()
    return (
        spark.createDataFrame(decomposed, "ch string, parts array<struct<c:string,ccc:int>>"),
        spark.createDataFrame(composed, "seq string, composed string"),
    )


def affected(col: Column) -> Column:
    """Whether a text may have a character that the tables change, or blanks other than single ones.

    A cheap class that holds all such characters: everything but plain ASCII and plain Han, and the few
    of those that have a row.
    """
    rows = "".join(ch for ch, _ in tables_()[0] if " " < ch <= "~" or "\u4e00" <= ch <= "\u9fff")
    return col.rlike(f"[^\\x20-\\x7e\\x{{4e00}}-\\x{{9fff}}\u00b7]|[{rows}]|  ")


def plain_twins(names: list[str]) -> str:
    """Plain characters that look like a character of the names: written with them a name is no longer affected()."""
    folded = [parts_of(c) for c in set("".join(names))]
    return "".join(sorted({p for c, x in zip(set("".join(names)), folded) if x != c and not any(map(unicodedata.combining, x)) for p in x if p != " "}))


def any_of(col: Column, chars: str) -> Column:
    """Whether a text has one of the characters."""
    return F.translate(col, chars, "") != col if chars else F.lit(False)


def text_id(col: str) -> list[Column]:
    """Two hashes, 96 bits, that stand for a text: a long text must not be carried by each of its characters."""
    return [F.xxhash64(col).alias("t1"), F.hash(col).alias("t2")]


def one_form(texts: DataFrame, col: str) -> DataFrame:
    """(t1, t2, clean): the consistent form of each distinct text of the column, by text_id()."""
    spark = texts.sparkSession
    mapping, compose = _map_tables(spark)
    of = ["t1", "t2"]
    distinct = texts.select(*text_id(col), F.col(col).alias("text")).distinct().repartition(*of)
    chars = distinct.select(*of, F.posexplode(F.regexp_extract_all("text", F.lit("(?s)."), 0)).alias("pos", "ch"))
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc")))
    parts = chars.join(F.broadcast(mapping), "ch", "left").select(*of, "pos", F.posexplode_outer(F.coalesce("parts", own)).alias("sub", "part"))
    order = W.partitionBy(*of).orderBy("pos", "sub")
    parts = parts.select(*of, "pos", "sub", "part", F.sum(F.when(F.col("part.ccc") == 0, 1).otherwise(0)).over(order).alias("starter"))
    join = lambda array, field: F.array_join(F.transform(F.array_sort(array), lambda x: x[field]), "")
    sequences = parts.groupBy(*of, "starter").agg(join(F.collect_list(F.when(F.col("part").isNotNull(), F.struct(F.col("part.ccc").alias("ccc"), "pos", "sub", F.col("part.c").alias("c")))), "c").alias("seq"))
    sequences = sequences.join(F.broadcast(compose), "seq", "left")
    rebuilt = sequences.groupBy(*of).agg(join(F.collect_list(F.struct("starter", F.coalesce("composed", "seq").alias("c"))), "c").alias("clean"))
    return rebuilt.select(*of, F.trim(F.regexp_replace("clean", " +", " ")).alias("clean"))


NUMBER = "invoice.invoice_number"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay, inv, known = (table(spark, sf_dir, t) for t in ("payment", "invoice", "known_names"))
    cols = lambda field, value: [F.lit(field).alias("field"), F.col("id").alias("rec_id"), F.col(value).alias("value")]
    names = pay.select(*cols("payment.merchant_name", "merchant_name")).unionByName(inv.select(*cols("invoice.seller_name", "seller_name")))
    numbers = inv.select(*cols(NUMBER, "invoice_number")).filter(F.col("value").rlike(r"[^\x00-\x7f]"))
    # the agreed names are a fixed table; spelt right they are no case, however many rows have them
    known = known.select("name").distinct()
    twins = plain_twins([r[0] for r in few(known)])
    names = names.filter((F.col("value") != "") & (affected(F.col("value")) | any_of(F.col("value"), twins))).withColumn("bare", F.regexp_replace("value", r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    names = names.join(F.broadcast(known), F.col("bare") == F.col("name"), "left_anti").drop("bare")
    rows = names.unionByName(numbers)
    keys = known.select("name", *text_id("name")).join(one_form(known, "name"), ["t1", "t2"]).select("name", F.col("clean").alias("key"))
    clean = one_form(rows, "value")
    found = clean.join(F.broadcast(keys), F.col("clean") == F.col("key"), "left").select("t1", "t2", "clean", "name")
    rows = rows.select("field", "rec_id", *text_id("value")).join(found, ["t1", "t2"])
    number = F.col("field") == NUMBER
    return rows.filter(number | F.col("name").isNotNull()).select("field", "rec_id", F.when(number, F.col("clean")).otherwise(F.col("name")).alias("clean"))
