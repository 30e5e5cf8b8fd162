"""Freely typed values mapped to a reference list, with the unmatched reported.

The writings of every reference entry (name, name without its ending, Latin name, code, with and without
the province) go into BK-trees under the unrestricted Damerau-Levenshtein distance, a true metric:
insertions, deletions, substitutions and transpositions of neighbours count one. A typed value is reduced
to its core readings (width, blanks, endings such as stations, airports and districts); the triangle
inequality prunes the search, which returns every writing within the threshold; the nearest entry wins.

The search is a fixed sequence of probes (readings from the nearest to the loosest), and the first probe that
decides gives the answer. The reference is broadcast up to ``BROADCAST_ROWS`` entries; beyond that it is
split into shards, each value makes all its probes in every shard, and the shards' hits are merged probe by probe, so
the answer is the same.

Defined results: NULL and empty values are no cases; a value that fits no entry, or several equally well
after a correction, gets -1; exact ties of equal names take the smallest id. Repeated values are searched
once. A very long value is searched by its prefixes and gets -1 where they fit nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.tables import cut, table

BROADCAST_ROWS = 50_000
# Traditional and variant forms of characters in place names, and their usual forms.
VARIANTS = "鎮灣埡崗暉瀾雲霽嵐靑瀏濟蘇廣東門縣區島嶺無長陽陰龍馬鳳陳楊華濱漢蘭寧貴慶錦鄭連營鐵蓮萊鹽湯豐興義瀋鞍頭寶雞場機國潿峯淸淵溫臺灤滄衞蕪銅縉雙順倉麗黃葉應鄉樂離靈關蔥渦濰榮鷄鬱貢賀"
USUAL = "镇湾垭岗晖澜云霁岚青浏济苏广东门县区岛岭无长阳阴龙马凤陈杨华滨汉兰宁贵庆锦郑连营铁莲莱盐汤丰兴义沈鞍头宝鸡场机国涠峰清渊温台滦沧卫芜铜缙双顺仓丽黄叶应乡乐离灵关葱涡潍荣鸡郁贡贺"
PROVINCE_ENDS = ("特别行政区", "维吾尔自治区", "壮族自治区", "回族自治区", "自治区", "省")
CITY_ENDS = ("自治州", "地区", "市", "州", "盟", "县")
TRANSLATE = {ord(a): b for a, b in zip(VARIANTS, USUAL, strict=True)}
HAN = re.compile(r"[㐀-鿿]")
SPOT = re.compile(r"(?:[东西南北]|[东西南北]?站|.{0,6}(?:机场|航站楼|火车站|高铁站|客运站|汽车站|车站|码头|口岸|区|县|镇|乡|街道|路|园|广场|中心|市区|城区|会展中心|新城))(?:t?\d*)?(?:航站楼)?(?:\([^()]*\))?$")
TAIL = re.compile(r"(?:-出差|-差旅|\((?:市区|全省|全市|高铁|城区|出差)\)|[。.,，;；!！]+|/.*)$")
LATIN_TAIL = re.compile(r"(?:,? (?:international )?(?:airport|city|hbf|station|central|downtown|railway station)|,? (?:cn|china|downtown)|\s*\([a-z]{3}\)|\.)$")


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    big = n + m
    last: dict[str, int] = {}
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    d[1][1:] = range(m + 1)
    for i in range(1, n + 1):
        seen, x, row, prev = 0, a[i - 1], d[i + 1], d[i]
        for j in range(1, m + 1):
            k, col = last.get(b[j - 1], 0), seen
            if x == b[j - 1]:
                cost, seen = 0, j
            else:
                cost = 1
            row[j + 1] = min(prev[j] + cost, row[j] + 1, prev[j + 1] + 1, d[k][col] + i - k - 1 + 1 + j - col - 1)
        last[x] = i
    return d[n + 1][m + 1]


class BKTree:
    """Writings in a metric tree: below a node, the child at edge e holds the writings at distance e."""

    def __init__(self, words: Iterator[str] | list[str] = ()):
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while e := distance(word, node[0]):
            if e not in node[1]:
                node[1][e] = (word, {})
                return
            node = node[1][e]

    def within(self, word: str, most: int) -> list[tuple[int, str]]:
        """Every writing at most so far away, nearest first."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            at, below = todo.pop()
            e = distance(word, at)
            if e <= most:
                out.append((e, at))
            todo += [c for k, c in below.items() if e - most <= k <= e + most]
        return sorted(out)


def plain(text: str) -> str:
    """One width and case, no marks on Latin letters, usual Han forms, no invisible characters, single blanks."""
    text = unicodedata.normalize("NFKD", text).translate(TRANSLATE).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) not in ("Cf", "Cc") or c.isspace())
    return " ".join(unicodedata.normalize("NFC", text).replace("·", " ").replace("’", "'").split())


def _without(text: str, ends: tuple[str, ...]) -> str:
    return next((text[: -len(e)] for e in ends if text.endswith(e) and len(text) > len(e) + 1), text)


def squeezed(text: str) -> str:
    return re.sub(r"[\s'\-]", "", text)


HIT, STOP = 0, 1


class Gazetteer:
    """The writings of the reference entries, or of a shard of them, and the search among them."""

    def __init__(self, rows: list[tuple[int, str, str, str | None, str | None, str | None]]):
        self.han: dict[str, set[int]] = {}
        self.latin: dict[str, set[int]] = {}
        self.codes: dict[str, set[int]] = {}
        self.provinces: dict[str, str] = {}
        self.inside: dict[str, dict[str, set[int]]] = {}
        for place_id, name, kind, province, latin, code in rows:
            name = plain(name)
            forms = {name, _without(name, PROVINCE_ENDS if kind == "province" else CITY_ENDS)}
            if kind == "province":
                self.provinces.update(dict.fromkeys(forms, name))
            for f in forms:
                if HAN.search(f):
                    self.han.setdefault(f, set()).add(place_id)
                    if province:
                        self.inside.setdefault(plain(province), {}).setdefault(f, set()).add(place_id)
                else:
                    self.latin.setdefault(squeezed(f), set()).add(place_id)
            if latin:
                self.latin.setdefault(squeezed(plain(latin)), set()).add(place_id)
            if code:
                self.codes.setdefault(plain(code), set()).add(place_id)
        self.tree = {"han": BKTree(sorted(self.han)), "latin": BKTree(sorted(self.latin))}
        self.province_trees = {p: BKTree(sorted(f)) for p, f in self.inside.items()}
        self.longest = max(map(len, self.han), default=0)
        self.longest_province = max(map(len, self.provinces), default=0)

    def find(self, value: str) -> int:
        """The entry that a value means, -1 if none fits: the first probe that decides."""
        for _, kind, got in self.probes(value):
            if kind == STOP:
                if got[0] and not got[1]:
                    return -1
            elif got[0] == 0 or got[1] == got[2]:
                return got[1]
        return -1

    def probes(self, value: str) -> Iterator[tuple[list[int], int, tuple[int, int, int]]]:
        """(place in the sequence, kind, result) of the probes that hit something, in their order.

        HIT: (distance, smallest, largest entry) of the nearest; several after a correction decide nothing.
        STOP: (whether the province has entries, whether an entry forbids the stop, 0): a spot of a province, no city.
        """
        text = plain(value)
        if text:
            yield from self._han(squeezed(text), text) if HAN.search(text) else self._latin(text)

    @staticmethod
    def _nearest(place: list[int], tree: BKTree, ids: dict[str, set[int]], word: str, most: int) -> Iterator[tuple[list[int], int, tuple[int, int, int]]]:
        hits = tree.within(word, most) if most else [(0, word)] * (word in ids)
        if hits:
            best = {i for e, w in hits if e == hits[0][0] for i in ids[w]}
            yield place, HIT, (hits[0][0], min(best), max(best))

    def _latin(self, text: str):
        readings = [text]
        while (cut := LATIN_TAIL.sub("", readings[-1]).strip()) != readings[-1] and cut:
            readings.append(cut)
        for step, r in enumerate(readings):
            core = squeezed(r)
            if core in self.codes and r.isalpha():
                yield [0, step, 0], HIT, (0, min(self.codes[core]), max(self.codes[core]))
            yield from self._nearest([0, step, 1], self.tree["latin"], self.latin, core, 0)
        for step, r in enumerate(readings):
            core = squeezed(r)
            if len(core) >= 4 and core.isalpha():
                yield from self._nearest([1, step], self.tree["latin"], self.latin, core, 1 if len(core) < 9 else 2)

    def _han(self, text: str, spaced: str):
        readings = [text]
        for base in (squeezed(TAIL.sub("", spaced)), TAIL.sub("", text)):
            while base and base not in readings:
                readings.append(base)
                base = TAIL.sub("", base)
        for step, r in enumerate(readings):
            yield from self._nearest([0, step], self.tree["han"], self.han, r, 0)
        for step, r in enumerate(readings):
            for cut in range(min(len(r) - 1, self.longest_province), 1, -1):
                if r[:cut] not in self.provinces:
                    continue
                rest, at = r[cut:], [1, step, -cut]
                ids = self.inside.get(self.provinces[r[:cut]], {})
                if ids:
                    tree = self.province_trees[self.provinces[r[:cut]]]
                    yield from self._nearest([*at, 0], tree, ids, rest, 0)
                    yield from self._prefix([*at, 1], tree, ids, rest)
                    if len(rest) > 2 and rest.endswith(CITY_ENDS):
                        yield from self._nearest([*at, 2], tree, ids, rest, 1)
                if r[:cut].endswith(PROVINCE_ENDS) and SPOT.match(rest):
                    yield [*at, 3], STOP, (int(bool(ids)), int(next(self._prefix([], self.tree["han"], self.han, r), None) is not None), 0)
        for step, r in enumerate(readings):
            yield from self._prefix([2, step], self.tree["han"], self.han, r)
        for step, r in enumerate(readings):
            if len(r) > 2:
                yield from self._nearest([3, step], self.tree["han"], self.han, r, 1)

    def _prefix(self, place: list[int], tree: BKTree, ids: dict[str, set[int]], text: str):
        """The entries that the value begins with, longest first, if a place of that city follows."""
        for cut in range(min(len(text) - 1, self.longest), 1, -1):
            if text[:cut] in ids and SPOT.match(text[cut:]):
                yield from self._nearest([*place, -cut], tree, ids, text[:cut], 0)


VALUES = 20_000  # distinct values that one task searches in a shard


def match(values: DataFrame, col: str, reference: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(col, place_id) of the distinct values of the column; -1 where no entry fits."""
    spark = values.sparkSession
    cols = ["place_id", "name", "kind", "province", "latin_name", "code"]
    distinct = values.select(col).distinct()
    if reference.count() <= broadcast_rows:
        shared = spark.sparkContext.broadcast([tuple(r) for r in reference.select(cols).collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            places = Gazetteer(shared.value)
            for b in batches:
                b["place_id"] = [places.find(v) for v in b[col]]
                yield b

        return distinct.mapInPandas(run, f"`{col}` string, place_id int")
    return _sharded(distinct, col, reference.select(cols), broadcast_rows)


def _sharded(distinct: DataFrame, col: str, reference: DataFrame, broadcast_rows: int) -> DataFrame:
    """Each shard of the reference becomes one row; values meet every shard, and their probes' hits are merged."""
    shards = -(-reference.count() // max(1, broadcast_rows // 2))
    distinct = cut(distinct.filter(F.col(col).isNotNull()))
    blocks = max(1, -(-distinct.count() // VALUES))
    names = reference.columns
    own = reference.filter(F.coalesce(F.col("kind") != "province", F.lit(True))).withColumn("shard", F.pmod(F.xxhash64("place_id"), F.lit(shards)).cast("int"))
    # values name provinces in front of cities, so every shard knows all provinces, which are few
    every = reference.filter("kind = 'province'").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    packed = own.unionByName(every).groupBy("shard").agg(F.collect_list(F.struct(*names)).alias("rows"))
    left = distinct.withColumn("block", F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        places = Gazetteer([tuple(r[c] for c in names) for rows in right["rows"] for r in rows])
        found = [(v, place, kind, *got) for v in left[col] for place, kind, got in places.probes(v)]
        return pd.DataFrame(found, columns=[col, "place", "kind", "e", "lo", "hi"])

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, f"`{col}` string, place array<int>, kind int, e int, lo int, hi int")
    near, far = F.min(F.struct("e", "lo")).alias("a"), F.min(F.struct("e", (-F.col("hi")).alias("hi"))).alias("b")
    merged = hits.groupBy(col, "place", "kind").agg(near, far, F.max("e").alias("inside"), F.max("lo").alias("forbidden"))
    stop = F.when((F.col("inside") == 1) & (F.col("forbidden") == 0), F.lit(-1))
    decided = F.when(F.col("kind") == STOP, stop).otherwise(F.when((F.col("a.e") == 0) | (F.col("a.lo") == -F.col("b.hi")), F.col("a.lo")))
    first = merged.withColumn("place_id", decided).filter("place_id is not null").groupBy(col).agg(F.min_by("place_id", "place").alias("place_id"))
    return distinct.join(first, col, "left").select(col, F.coalesce("place_id", F.lit(-1)).alias("place_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv, hotel, ref = (table(spark, sf_dir, t) for t in ("invoice", "hotel_standard", "place_ref"))
    field = lambda name, rec, at, value: [F.lit(name).alias("field"), rec.cast("string").alias("rec_id"), at.alias("item_index"), value.alias("value")]
    rides = inv.select("id", F.posexplode("itineraries").alias("at", "ride"))
    regions = hotel.select("entry_id", F.posexplode(F.split("region", "、")).alias("at", "item"))
    none = F.lit(-1)
    rows = (
        inv.select(*field("invoice.departure_city", F.col("id"), none, F.col("departure_city")))
        .unionByName(inv.select(*field("invoice.arrival_city", F.col("id"), none, F.col("arrival_city"))))
        .unionByName(rides.select(*field("itinerary.city", F.col("id"), F.col("at"), F.col("ride.city"))))
        .unionByName(regions.select(*field("hotel_standard.region", F.col("entry_id"), F.col("at"), F.col("item"))))
        .filter(F.col("value") != "")
    )
    rows = rows.join(ref.select(F.col("name").alias("value")).distinct(), "value", "left_anti")
    return rows.join(match(rows, "value", ref), "value").select("field", "rec_id", "item_index", "place_id")
