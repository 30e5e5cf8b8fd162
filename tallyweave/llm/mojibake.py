"""Garbled text from wrong character decoding: find it, give back the original text.

A value that was decoded with the wrong encoding still holds the bytes of the original. For each pair of
a wrong and a right encoding the characters are mapped back to legacy bytes, a byte-structure automaton
finds the maximal well-formed multibyte spans, and only those spans are decoded; everything else stays.
The reading is accepted if it is clearly more usual than the value as it stands, by the log frequency of
characters over all distinct values of the data (counts of all rows, no sample). Values garbled several times are
decoded until no reading is better.

Defined results: NULL and empty values are no cases. A value that lost characters (U+FFFD, ``?`` or stray
bytes beside a garbled span) gives the empty string. Repeated values are decoded once and reported for
each row. Very long values are decoded whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.tables import few, table

# Encodings a text may wrongly have been decoded with: one byte a character, then several.
SINGLE = ("latin-1", "cp1252", "cp437", "cp850", "cp866", "koi8-r", "cp1251", "mac-roman", "cp1250", "cp1254", "iso8859-15")
MULTI = ("gb18030", "big5", "cp932", "cp949", "euc-jp")
RIGHT = ("utf-8", "gb18030", "cp932", "cp949", "big5", "euc-jp")
# Pairs that are common; any other pair must explain every character above ASCII by characters that several values have.
USUAL_PAIRS = {(w, r) for w in SINGLE + MULTI for r in ("utf-8", "gb18030")} | {(w, r) for w in ("latin-1", "cp1252") for r in RIGHT}
_UTF8 = rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+"
# Byte-structure automata: maximal runs of well-formed multibyte characters.
AUTOMATA = {
    "utf-8": re.compile(_UTF8),
    "gb18030": re.compile(rb"(?:[\x81-\xFE][0-9][\x81-\xFE][0-9]|[\x81-\xFE][\x40-\x7E\x80-\xFE])+"),
    "cp932": re.compile(rb"(?:[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]|[\xA1-\xDF])+"),
    "cp949": re.compile(rb"(?:[\x81-\xFE][\x41-\x5A\x61-\x7A\x81-\xFE])+"),
    "big5": re.compile(rb"(?:[\x81-\xFE][\x40-\x7E\xA1-\xFE])+"),
    "euc-jp": re.compile(rb"(?:[\xA1-\xFE]{2}|\x8E[\xA1-\xDF]|\x8F[\xA1-\xFE]{2})+"),
}
LOST = "\ufffd"
# Question marks in place of letters: a run of them, or one inside a word.
LOST_ASCII = re.compile(r"\?\?|\?[A-Za-z]")
HIGH = re.compile(r"[^\x00-\x7f]+")
WIDE = re.compile("[\u2e80-\ud7ff\ue000-\uf8ff\uf900-\uffef\U00020000-\U0003ffff]")
LONG_SPAN = 6  # characters above ASCII
HIGH_AND_TRAIL = re.compile(r"(?:[^\x00-\x7f][0-9@-~]?)+")


@lru_cache(maxsize=None)
def _single_table(name: str) -> tuple[dict[int, int], re.Pattern]:
    """Code point to byte, and the runs of such characters above ASCII.

    Bytes a code page leaves open stand for the C1 control of the same number.
    """
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    for b in range(128, 160):
        out.setdefault(b, b)
    high = "".join(re.escape(chr(c)) for c in out if c > 127)
    return out, re.compile(f"(?:[{high}][0-9@-~]?)+")


@lru_cache(maxsize=1)
def _any_single() -> re.Pattern:
    """A character above ASCII that some one-byte encoding has."""
    return re.compile("[" + "".join(sorted({re.escape(chr(c)) for w in SINGLE for c in _single_table(w)[0] if c > 127})) + "]")


def _pieces(text: str, wrong: str, trail: bool) -> Iterator[tuple[int, int, bytes, list[int] | None]]:
    """(start, end, bytes, byte offset of each character or None for one byte each) of the encodable runs."""
    if wrong not in MULTI:
        table_, runs = _single_table(wrong)
        for m in runs.finditer(text):
            yield m.start(), m.end(), m[0].translate(table_).encode("latin-1"), None
        return
    for m in (HIGH_AND_TRAIL if trail else HIGH).finditer(text):
        i, n = m.start(), m.end()
        try:
            raw = m[0].encode(wrong)
        except UnicodeEncodeError:
            raw = None
        if raw is not None:
            # most runs have no span, so the place of each character is worked out only where one is found
            if AUTOMATA["utf-8"].search(raw) or trail:
                yield i, n, raw, _offsets(m[0], wrong)
            continue
        while i < n:
            j, parts = i, []
            while j < n and (one := _multi(text[j], wrong)) is not None:
                parts.append(one)
                j += 1
            if j > i:
                yield i, j, b"".join(parts), list(accumulate(map(len, parts), initial=0))
            i = j + 1


def _offsets(run: str, wrong: str) -> list[int]:
    return list(accumulate((len(_multi(c, wrong)) for c in run), initial=0))


@lru_cache(maxsize=100_000)
def _multi(ch: str, wrong: str) -> bytes | None:
    try:
        return ch.encode(wrong)
    except UnicodeEncodeError:
        return None


def _starts(run: bytes, a: int, b: int, right: str) -> list[int]:
    """Byte offsets in run[a:b] at which a character of the right encoding may begin, and the end."""
    if right == "utf-8":
        return [k for k in range(a, b) if not 0x80 <= run[k] <= 0xBF] + [b]
    out, k = [], a
    while k < b:
        out.append(k)
        if run[k] < 0x80 or (right == "cp932" and 0xA1 <= run[k] <= 0xDF):
            k += 1
        elif right == "gb18030" and k + 1 < b and 0x30 <= run[k + 1] <= 0x39:
            k += 4
        else:
            k += 3 if right == "euc-jp" and run[k] == 0x8F else 2
    return [*out, b]


def decode_spans(text: str, wrong: str, right: str, fine: frozenset | set = frozenset(), pieces: list | None = None) -> tuple[str, int, bool] | None:
    """(reading, characters decoded, whether stray bytes remain beside the spans); None if there is no span.

    ``fine`` are characters that are usual as they stand and so no strays; ``pieces``: what _pieces() gave, if known.
    """
    strays = lambda part: any(not (c.isascii() or c in fine) for c in part)
    out, decoded, stray, last = [], 0, False, 0
    for i, j, run, at in _pieces(text, wrong, right != "utf-8") if pieces is None else pieces:
        spans = AUTOMATA[right].finditer(run)
        index = {b: i + k for k, b in enumerate(at)} if at else None
        pos = i
        for m in spans:
            a, b = m.start(), m.end()
            if index is not None:  # the span must begin and end between characters of both readings
                cuts = [k for k in _starts(run, a, b, right) if k in index]
                a, b = (cuts[0], cuts[-1]) if len(cuts) > 1 else (0, 0)
            if a >= b or run[a:b].isascii():
                continue
            try:
                new = run[a:b].decode(right)
            except UnicodeDecodeError:
                continue
            x, y = (index[a], index[b]) if index is not None else (i + a, i + b)
            if not text[x:y].strip("\xad\xa0"):
                continue
            stray |= strays(text[pos:x])
            out += [text[last:x], new]
            decoded += sum(not c.isascii() for c in text[x:y])
            last = pos = y
        if pos > i:
            stray |= strays(text[pos:j])
    if not decoded:
        return None
    out.append(text[last:])
    return "".join(out), decoded, stray


class Usual:
    """Mean log frequency of a text's characters that are not ASCII; ASCII has a fixed cost."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(total, 1)
        self.counts = counts
        self.common = {c for c, n in counts.items() if n >= 0.003 * total and c.isalpha() and c > "\u2e80"} | {chr(c) for c in range(128)} | set("（）·")
        self.floor = math.log(0.3 / self.total)
        self.costs: dict[str, float] = {}

    def seen(self, text: str) -> bool:
        """Whether every character is European, or East Asian and in several values."""
        return all(c < "\u0530" or (c > "\u2000" and self.counts.get(c, 0) > 2) for c in text)

    def rare(self, text: str) -> float:
        """Share of the characters above ASCII that few values have."""
        high = [c for c in text if not c.isascii()]
        return sum(self.counts.get(c, 0) < 0.002 * self.total for c in high) / max(1, len(high))

    def plain(self, text: str) -> bool:
        return self.common.issuperset(text)

    def cost(self, ch: str) -> float:
        if ch.isascii():
            return -2.0 if ch >= " " else self.floor - 4
        n = self.counts.get(ch, 0)
        log = math.log((n + 0.3) / self.total)
        if "\x80" <= ch <= "\x9f" or ch == LOST or "" <= ch <= "":
            log -= 6
        elif not ch.isalnum():
            log -= 2
        return log

    def sum(self, text: str) -> float:
        known, out = self.costs, 0.0
        for c in text:
            x = known.get(c)
            if x is None:
                x = known[c] = self.cost(c)
            out += x
        return out


def _once(text: str, usual: Usual, gain: float) -> tuple[str, bool] | None:
    best, best_score, seen = None, usual.sum(text) + gain, set()
    cut = "?" in text or LOST in text
    high = sum(not c.isascii() for c in text)
    # text in characters of one kind can't have come from the other kind of encoding
    wrongs = (SINGLE if _any_single().search(text) else ()) + (MULTI if WIDE.search(text) else ())
    odd = usual.rare(text) >= 0.5
    found: dict[tuple[str, bool], list] = {}
    for right in RIGHT:
        done: set[tuple] = set()
        for wrong in wrongs:
            common = (wrong, right) in USUAL_PAIRS
            if wrong == right or not (common or odd):
                continue
            trail = right != "utf-8"
            kind = (wrong, trail if wrong in MULTI else True)
            if kind not in found:
                found[kind] = list(_pieces(text, *kind))
            pieces = found[kind]
            same = tuple((i, run) for i, _, run, _ in pieces)
            if not pieces or same in done:  # many encodings agree on a text's bytes
                continue
            done.add(same)
            got = decode_spans(text, wrong, right, usual.common, pieces)
            if got is None or got[0] == text or got[0] in seen:
                continue
            if not common and (got[2] or cut or high < 2 or got[1] < high or not usual.seen(got[0])):
                continue
            seen.add(got[0])
            if not got[2] and not cut and got[1] >= high and (right == "utf-8" or best is None) and usual.plain(got[0]):
                return got[0], False  # all of it decoded, to usual characters only: no other reading can be better
            if right == "utf-8" and common and not got[2] and not cut and got[1] >= high >= LONG_SPAN and usual.seen(got[0]):
                return got[0], False  # nor where so many bytes are well-formed UTF-8 without a stray
            # a well-formed UTF-8 span is hardly ever an accident; strays count against a reading that nothing was cut from
            score = usual.sum(got[0]) + (3 * got[1] if right == "utf-8" and usual.seen(got[0]) else 0) - (0 if cut else 12) * got[2]
            if score > best_score:
                best, best_score = (got[0], got[2]), score
    return best


def reading(text: str) -> str:
    """Compatibility form without invisible characters: how a value reads."""
    text = unicodedata.normalize("NFKC", text)
    return " ".join("".join(c for c in text if unicodedata.category(c) != "Cf" and not "\ufe00" <= c <= "\ufe0f").split())


def restore(text: str, usual: Usual, trusted: frozenset | set = frozenset(), gain: float = 6.0) -> str | None:
    """The original of a garbled value, '' when characters are lost, None when it isn't garbled.

    ``trusted`` are readings that are never garbled.
    """
    if usual.plain(text) and "?" not in text:
        return None
    read = reading(text)
    if read in trusted or ("?" not in text and LOST not in text and usual.plain(read)):  # only look-alike forms
        return None
    if text.isascii():
        return "" if LOST_ASCII.search(text) else None
    best, stray = None, False
    while (got := _once(best or text, usual, gain)) is not None:  # each pass is more usual than the one before, so they end
        best, stray = got[0], stray or got[1]
        if reading(best) in trusted:
            break
    if best is None:
        return "" if LOST in text or ("?" in text and usual.rare(text) >= 0.6) else None
    return "" if stray or LOST in best or ("?" in text and "?" in best) else best


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay, inv = table(spark, sf_dir, "payment"), table(spark, sf_dir, "invoice")
    rides = inv.select("id", F.posexplode("itineraries").alias("ride_index", "ride"))
    cols = lambda field, value, at: [F.lit(field).alias("field"), F.col("id").alias("rec_id"), at.alias("ride_index"), F.col(value).alias("value")]
    none = F.lit(-1)
    return (
        pay.select(*cols("payment.merchant_name", "merchant_name", none))
        .unionByName(inv.select(*cols("invoice.seller_name", "seller_name", none)))
        .unionByName(rides.select(*cols("itinerary.pickup", "ride.pickup", F.col("ride_index"))))
        .filter(F.col("value") != "")
    )


def character_counts(values: DataFrame) -> Usual:
    """In how many distinct values each character occurs; one row per code point comes to the driver."""
    distinct = values.select("value").distinct()
    chars = distinct.select(F.explode(F.array_distinct(F.split(F.concat(F.lit("\0"), "value"), ""))).alias("ch"))
    counts = {r["ch"]: r["n"] for r in chars.filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n")).collect()}
    return Usual(counts, counts.pop("\0", 0))


def restored(rows: DataFrame, usual: Usual, trusted: list[str]) -> DataFrame:
    """Adds ``restored`` to the rows whose ``value`` is garbled and drops the others. No shuffle.

    Workers decode each distinct value once: values repeat, so results are kept by value.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((usual.counts, usual.total, frozenset(map(reading, trusted))))
    names = [c for c in rows.columns if c != "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, total, known = shared.value
        model, kept = Usual(counts, total), {}
        for b in batches:
            new = [v for v in b["value"].unique() if v not in kept]
            if len(kept) > 500_000:
                kept.clear()
                new = list(b["value"].unique())
            kept.update((v, restore(v, model, known)) for v in new)
            b["restored"] = b["value"].map(kept)
            yield b[b["restored"].notna()][[*names, "restored"]]

    plain = "".join(sorted(c for c in usual.common if c.isalnum() and not c.isascii()))
    odd = F.col("value").rlike(f"[^\\x00-\\x3e\\x40-\\x7f（）·{plain}]")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "value")
    return rows.filter(odd).mapInPandas(run, kinds + ", restored string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir)
    # both tables are fixed and small: the agreed spellings are no garbled text
    trusted = [r[0] for t in ("known_names", "place_ref") for r in few(table(spark, sf_dir, t).select("name"))]
    return restored(rows, character_counts(rows), trusted)
