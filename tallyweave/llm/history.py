"""New batches checked for duplicates and near-duplicates against everything accepted before.

Records are vectors: their number (positional projections from the front and from the back, so that a lost
character keeps one side), amount and time. Workers hold the history as shards, each a navigable
small-world graph: nodes are linked to their neighbours and, at growing distances, to far nodes in several
orderings of the vectors. A batch is searched in every shard by a greedy walk with a beam, whose width is
tuned per shard, so again after each compaction, against exhaustive search on ``TUNE`` queries that have
something else than themselves to find, until ``RECALL`` is reached; what the beam brings within the radius
is reranked exactly on numbers, amounts, times and names. The batch then becomes a shard of its own, and
whenever ``FANOUT`` shards of one size have gathered they are compacted into one.

Where a beam can't be trusted the search is exact: small shards and those whose widest beam stays below
``RECALL`` are joined by key, and keys of more than ``LARGE`` rows, which no beam sees whole, don't enter
the graph; their distinct numbers are compared in bounded blocks (``links_of_key``).

Rows meet in two distributions: by number (equal numbers, however written) and by amount and time (damaged
numbers need both to agree). Hot keys are found by counting; their rows that are alike in all that is
compared are collapsed to the first one, so a number that a third of all rows share is one node, and what
stays hot is split into slices, each holding a part of the nodes and seeing all queries of the key.

p2_found checks all batches in one run. Between runs the history is kept as an Index: graph shards by batch in the
shared folder, of which a new batch reads only those of its buckets.

Defined results: rows without a number are no case; the first row of a class is reported for every later
row. An unreadable time never agrees with anything.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.gazetteer import distance
from tallyweave.llm.lookalikes import invisible, parts_of
from tallyweave.operators.zoned_time import plain_seconds, utc_seconds, with_walls
from tallyweave.tables import cut, table

CHARS = 40  # characters of a number that its projections see; the rerank compares whole numbers
DIMS = 8
SEGMENT = 16_384
FANOUT = 4
TUNE, RECALL = 48, 0.99
BEAMS = (2, 4, 8, 16, 32)
SMALL = 256  # nodes of a shard up to which it is joined by key
LARGE = 32  # rows of one key from which their numbers are compared exactly, outside of the graph
BLOCK = 500_000  # pairs of numbers compared at once
HOT = 50_000  # rows of one key from which it is split into slices
OFFSETS = (1, 3, 16, 128, 1024)


# ---------------------------------------------------------------- the graph


class Shard:
    """A navigable small-world graph over the vectors of one history segment."""

    ORDERINGS = 3

    def __init__(self, vectors: np.ndarray):
        self.v = vectors
        n = len(vectors)
        rng = np.random.RandomState(17)
        links, self.orders, self.keys = [], [], []
        self.directions = rng.normal(size=(self.ORDERINGS, vectors.shape[1]))
        for direction in self.directions:
            key = vectors.astype(np.float64) @ direction
            order = np.argsort(key, kind="stable")
            self.orders.append(order)
            self.keys.append(key[order])
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            for off in OFFSETS:
                if off < n:
                    links += [order[np.minimum(place + off, n - 1)], order[np.maximum(place - off, 0)]]
        self.links = np.stack(links, 1).astype(np.int32) if links else np.zeros((n, 1), np.int32)

    def entries(self, q: np.ndarray) -> np.ndarray:
        """Per query the nodes around its place in every ordering.

        The far links of an ordering are a skip list, so walking them to the query's place is a binary search.
        """
        out = []
        for direction, order, key in zip(self.directions, self.orders, self.keys):
            at = np.searchsorted(key, q.astype(np.float64) @ direction)
            out += [order[np.clip(at + k, 0, len(order) - 1)] for k in (-1, 0)]
        return np.stack(out, 1).astype(np.int32)

    def search(self, q: np.ndarray, beam: int, radius: float, hops: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(query numbers, node numbers) of the nodes within the radius that a beam walk meets."""
        found = [np.zeros(0, np.int64)]
        for a in range(0, len(q), 512):
            part = q[a : a + 512]
            at = self.entries(part)
            d = ((self.v[at] - part[:, None, :]) ** 2).sum(2)
            hits = [self._within(np.arange(len(part)), at, d, radius)]
            at, d = self._best(at, d, beam)
            open_ = np.arange(len(part))
            for _ in range(hops):
                near = self.links[at[open_]].reshape(len(open_), -1)
                nd = ((self.v[near] - part[open_, None, :]) ** 2).sum(2)
                hits.append(self._within(open_, near, nd, radius))
                new_at, new_d = self._best(np.hstack([at[open_], near]), np.hstack([d[open_], nd]), beam)
                better = new_d.sum(1) < d[open_, : new_d.shape[1]].sum(1) - 1e-9
                if new_at.shape[1] > at.shape[1]:
                    wide = new_at.shape[1] - at.shape[1]
                    at, d = np.hstack([at, np.repeat(at[:, -1:], wide, 1)]), np.hstack([d, np.repeat(d[:, -1:], wide, 1)])
                at[open_], d[open_] = new_at, new_d
                open_ = open_[better]
                if not len(open_):
                    break
            found.append(np.unique(np.concatenate(hits)) + a * len(self.v))
        both = np.concatenate(found)
        return both // max(1, len(self.v)), both % max(1, len(self.v))

    def _within(self, queries: np.ndarray, nodes: np.ndarray, d: np.ndarray, radius: float) -> np.ndarray:
        i, j = np.nonzero(d <= radius * radius)
        return queries[i].astype(np.int64) * len(self.v) + nodes[i, j]

    @staticmethod
    def _best(nodes: np.ndarray, d: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest distinct nodes; repeated ones, which have equal distances, are put last."""
        k = min(nodes.shape[1], beam * 3)
        if k < nodes.shape[1]:
            part = np.argpartition(d, k - 1, axis=1)[:, :k]
            nodes, d = np.take_along_axis(nodes, part, 1), np.take_along_axis(d, part, 1)
        order = np.lexsort((nodes, d), axis=1)
        nodes, d = np.take_along_axis(nodes, order, 1), np.take_along_axis(d, order, 1)
        d = d.copy()
        d[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = 1e18
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(nodes, order, 1).copy(), np.take_along_axis(d, order, 1)


def exhaustive(v: np.ndarray, q: np.ndarray, radius: float) -> set[tuple[int, int]]:
    a, b = np.nonzero(((v[None] - q[:, None]) ** 2).sum(2) <= radius * radius)
    return set(zip(a.tolist(), b.tolist()))


def tuned_beam(shard: Shard, q: np.ndarray, radius: float, own: np.ndarray | None = None) -> tuple[int, float]:
    """The narrowest beam that finds nearly all that exhaustive search finds for some of the queries.

    ``own``: each query's own node, -1 if it is none of the shard's; finding oneself doesn't count.
    """
    at = np.arange(len(q))[:: max(1, len(q) // TUNE)][:TUNE]
    some, self_ = q[at], np.full(len(at), -1) if own is None else own[at]
    others = lambda pairs: {(a, b) for a, b in pairs if self_[a] != b}
    truth = others(exhaustive(shard.v, some, radius))
    recall = 1.0
    for beam in BEAMS:
        got = others(zip(*(x.tolist() for x in shard.search(some, beam, radius))))
        recall = len(got & truth) / max(1, len(truth))
        if recall >= RECALL:
            break
    return beam, recall


def equal_keys(nodes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query numbers, node numbers) of all pairs with equal keys."""
    order = np.argsort(nodes, kind="stable")
    lo, hi = (np.searchsorted(nodes[order], queries, side) for side in ("left", "right"))
    n = hi - lo
    a = np.repeat(np.arange(len(queries)), n)
    return a, order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(a))]


def vectors(numbers: np.ndarray, amounts: np.ndarray, minutes: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Record vectors. ``exact``: rows that meet by number, whose amounts and times must not matter.

    Amount and time parts are whole numbers, so records that differ in either are at least 1 apart, while
    the number parts stay within 0.05.
    """
    n = len(numbers)
    rng = np.random.RandomState(5)
    out = np.zeros((n, DIMS), np.float32)
    if not n:
        return out
    fixed = numbers.astype(f"U{CHARS}")
    codes = np.ascontiguousarray(fixed).view(np.uint32).reshape(n, CHARS)
    lengths = (codes > 0).sum(1)
    back = (np.arange(CHARS)[None] - (CHARS - lengths)[:, None]) % CHARS
    right = np.take_along_axis(codes, back, 1)
    value = lambda c: ((c.astype(np.float32) - 48) / 10) * (c > 0)
    out[:, 4:6] = value(codes) @ rng.uniform(-1, 1, (CHARS, 2)).astype(np.float32)
    out[:, 6:8] = value(right) @ rng.uniform(-1, 1, (CHARS, 2)).astype(np.float32)
    near = ~exact
    out[:, 4:8] = np.where(near[:, None], 0.012 * np.tanh(out[:, 4:8] / 4), out[:, 4:8])
    cents, minute = amounts.astype(np.int64), minutes.astype(np.int64)
    for j, part in enumerate((cents % 2039, (cents // 2039) % 4093, minute % 1440, (minute // 1440) % 4093)):
        out[near, j] = part[near]
    return out


class Shards:
    """Shards of growing size with their scheduled compaction. ``keys``: of all records; pairs need equal ones."""

    def __init__(self, radius: float, keys: np.ndarray):
        self.radius, self.keys, self.levels = radius, keys, []

    def search(self, q_ids: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, record numbers) per shard."""
        out = []
        for _, ids, shard, tuned in self.levels:
            if len(ids) > SMALL and "beam" not in tuned:
                self._tune(ids, shard, tuned, q_ids, q)
            if tuned.get("beam"):
                a, b = shard.search(q, tuned["beam"], self.radius)
            else:
                a, b = equal_keys(self.keys[ids], self.keys[q_ids])
            out.append((a, ids[b]))
        return out

    def _tune(self, ids: np.ndarray, shard: Shard, tuned: dict, q_ids: np.ndarray, q: np.ndarray) -> None:
        """Sets the shard's beam, None if the widest stays below RECALL; not before a query has something to find."""
        a, b = equal_keys(self.keys[ids], self.keys[q_ids])
        some = np.unique(a[ids[b] != q_ids[a]])
        if not len(some):
            return
        place = np.searchsorted(ids, q_ids[some])  # ids ascend
        own = np.where(ids[np.minimum(place, len(ids) - 1)] == q_ids[some], place, -1)
        beam, tuned["recall"] = tuned_beam(shard, q[some], self.radius, own)
        tuned["beam"] = beam if tuned["recall"] >= RECALL else None

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        """The batch becomes a shard; FANOUT shards of one level are compacted into one of the next."""
        self.levels.append((0, ids, Shard(v), {}))
        while sum(x[0] == self.levels[-1][0] for x in self.levels) >= FANOUT:
            lv = self.levels[-1][0]
            old = [x for x in self.levels if x[0] == lv]
            self.levels = [x for x in self.levels if x[0] != lv]
            self.levels.append((lv + 1, np.concatenate([x[1] for x in old]), Shard(np.concatenate([x[2].v for x in old])), {}))


# ---------------------------------------------------------------- numbers, names and the exact rerank


PREFIX = re.compile(r"^(?:NO\s*[.:]?\s*(?=\d)|№\s*|')", re.ASCII)
FILLING = re.compile(r"[\s\-\x00-\x1f]|\.+\s*$", re.ASCII)
PLAIN_NUMBER = "^[1-9][0-9]*$"


@lru_cache(maxsize=10_000)
def _reads(ch: str) -> str:
    """A character of a number in ASCII if it reads so, '' if it is invisible."""
    if ch.isascii() or "㐀" <= ch <= "\ud7ff":
        return ch
    p = parts_of(ch)
    return "" if invisible(ch) else p if len(p) == 1 and p.isascii() else ch


def written_once(number: str) -> str:
    """A number in one writing: ASCII, upper case, no blanks, hyphens, prefixes, leading zeros or final stops."""
    x = (number if number.isascii() else "".join(map(_reads, number))).upper().strip(" ")
    x = FILLING.sub("", PREFIX.sub("", x, count=1))
    return x.lstrip("0") or x[-1:]


def one_number(col: Column) -> Column:
    """written_once() in Arrow batches."""

    @F.pandas_udf("string")
    def rest(numbers: pd.Series) -> pd.Series:
        return numbers.map(written_once, na_action="ignore")

    return rest(col)


def with_number(rows: DataFrame, col: str) -> DataFrame:
    """Adds ``number``: written_once() of the column, '' for NULL. Only numbers that aren't plain digits go through Python."""
    there = rows.withColumn("number", F.coalesce(F.col(col), F.lit("")))
    easy = (F.col("number") == "") | F.col("number").rlike(PLAIN_NUMBER)
    return there.filter(easy).unionByName(there.filter(~easy).withColumn("number", one_number(F.col("number"))))


def timed_payments(pay: DataFrame, batches: DataFrame) -> DataFrame:
    """Adds the batch's columns, ``sec`` (UTC seconds of the payment, -1 if unreadable) and ``number`` to payments.

    Rows whose time and number are in the commonest writing stay in the JVM; the others go through Python.
    """
    zones = with_walls(batches.select("batch_id", "received_on", "zone_name", "date_order"))
    utc = utc_seconds(pay.sparkSession, zones)
    rows = pay.join(zones, "batch_id", "left").withColumn("number", F.coalesce("transaction_id", F.lit("")))
    fast = plain_seconds(F.col("transaction_time"), F.col("walls"))
    easy = F.coalesce(fast.isNotNull() & ((F.col("number") == "") | F.col("number").rlike(PLAIN_NUMBER)), F.lit(False))
    sec = utc(F.col("transaction_time"), F.col("zone_name"), F.col("date_order"), F.col("received_on"))
    hard = rows.filter(~easy).drop("walls").withColumns({"sec": sec, "number": one_number(F.col("number"))})
    return rows.filter(easy).withColumn("sec", fast).drop("walls").unionByName(hard)


CUT = re.compile(r"^(\d)\.?(\d*)E\+?(\d+)$")  # rounded by a spreadsheet
DERIVED = re.compile(r"(?:[*_].*)$")
SWAPS = str.maketrans("OILSBZ", "011582")


def near(x: str, y: str, most: int) -> bool:
    """Whether two numbers are at most so many edits apart; what both begin or end with costs nothing to compare."""
    n = min(len(x), len(y))
    i = next((k for k in range(n) if x[k] != y[k]), n)
    j = next((k for k in range(n - i) if x[-1 - k] != y[-1 - k]), n - i)
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    if not x or not y:
        return len(x) + len(y) <= most
    if sum(abs(x.count(c) - y.count(c)) for c in set(x + y)) > 2 * most:  # an edit changes two counts by one at most
        return False
    return distance(x, y) <= most


def numbers_alike(a: str, b: str) -> bool | None:
    """Whether one number may be the other damaged: True, False, or None if too little of it is left to tell."""
    if DERIVED.sub("", a) != a or DERIVED.sub("", b) != b:
        da, db = DERIVED.search(a), DERIVED.search(b)
        if (da is None) != (db is None):
            return False
    ca, cb = CUT.match(a), CUT.match(b)
    if ca or cb:
        pa, pb = (c[1] + c[2] if c else x for c, x in ((ca, a), (cb, b)))
        k = min(len(pa), len(pb)) - 1
        return None if pa[:k] == pb[:k] else False
    if (x := a.translate(SWAPS)) == (y := b.translate(SWAPS)):
        return True
    short, long_ = sorted((x, y), key=len)
    if len(short) >= 6 and (long_.startswith(short) or long_.endswith(short)):
        return True if len(short) * 2 >= len(long_) else None
    if abs(len(x) - len(y)) > 4:
        return False
    return near(x, y, max(2, min(4, len(long_) // 5)))


def names_alike(a: str | None, b: str | None) -> bool:
    """Whether two names may be one: equal or partly equal readings, or one of them missing or unreadable."""
    a, b = (_reading(x) for x in (a or "", b or ""))
    if not a or not b or a == b:
        return True
    odd = lambda x: sum(not (c.isascii() or "一" <= c <= "鿿") for c in x) * 3 > len(x)
    if odd(a) or odd(b):
        return True
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    if not x or not y:
        return a in b or b in a
    return len(x & y) * 2 >= min(len(x), len(y))


def _reading(x: str) -> str:
    return "".join(p for c in x for p in parts_of(c) if p.isalnum()).casefold()


# ---------------------------------------------------------------- exact comparison of a large key


def distances(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, most: int = 4) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of pairs of numbers, right up to ``most``, else above it.

    ``a`` and ``b`` hold a pair in each column, as codes padded with 0; only cells within ``most`` of the
    diagonal can lie on a path that cheap, and swapped letters are at most most - 1 apart.
    """
    rows, n = a.shape
    wide = 2 * most
    far = np.uint8(100)
    bb = np.full((rows + 2 * wide + 1, n), 1, a.dtype)  # codes are above 1, so the ends equal nothing
    bb[wide : wide + rows] = np.where(np.arange(rows)[:, None] < lb, b, 1)
    d = {0: np.full((2 * most + 1, n), far, np.uint8)}
    d[0][most:] = np.arange(most + 1)[:, None]
    equal: dict[int, np.ndarray] = {}
    out = np.full(n, far, np.uint8)
    out[la == 0] = np.minimum(lb[la == 0], 100)
    columns = np.arange(n)
    for i in range(1, rows + 1):
        # equal[i][wide + o]: whether letter i of a is letter i + o of b, both counted from 1
        eq = np.stack([a[i - 1] == bb[x] if 0 <= x else np.zeros(n, bool) for x in range(i - 1, i + 2 * wide)])
        equal[i] = eq
        up = d[i - 1]
        row = up + ~eq[wide - most : wide + most + 1]
        row[:-1] = np.minimum(row[:-1], up[1:] + 1)
        for o in range(-most, most + 1):
            for g1 in range(min(most, i - 1)):
                for g2 in range(most - g1):
                    k, at = i - 1 - g1, o - g2 + g1
                    if -most <= at <= most:
                        swap = equal[k][wide + o + 1 + g1] & eq[wide + o - 1 - g2]
                        row[o + most] = np.where(swap, np.minimum(row[o + most], d[k - 1][at + most] + (g1 + g2 + 1)), row[o + most])
        for o in range(1 - most, most + 1):
            row[o + most] = np.minimum(row[o + most], row[o + most - 1] + 1)
        row = np.minimum(row, far)
        for o in range(-most, min(most + 1, 1 - i + most) if i <= most else -most):
            if i + o < 0:
                row[o + most] = far
        d[i] = row
        d.pop(i - most - 1, None)
        equal.pop(i - most - 1, None)
        ends = (la == i) & (abs(lb - la) <= most)
        out[ends] = row[(lb - la)[ends] + most, columns[ends]]
    return out


def candidates(numbers: list[str], left: int | None = None) -> Iterator[tuple[int, int]]:
    """Pairs i < j of distinct numbers, among them all for which numbers_alike() isn't False; some repeat.

    With ``left`` only pairs with one of the first so many numbers are needed; others may come.
    """
    left = len(numbers) if left is None else left
    cut_ = [i for i, x in enumerate(numbers) if CUT.match(x)]
    for i in cut_:
        yield from ((min(i, j), max(i, j)) for j in range(len(numbers) if i < left else left) if j != i)
    gone = set(cut_)
    whole = [i for i in range(len(numbers)) if i not in gone]
    texts = [numbers[i].translate(SWAPS) for i in whole]
    by_text: dict[str, list[int]] = {}
    for i, x in zip(whole, texts):
        by_text.setdefault(x, []).append(i)
    sizes = sorted({len(x) for x in by_text if len(x) >= 6})
    for x, own in by_text.items():
        yield from ((i, j) for i in own for j in own if i < j)
        parts = {y for k in sizes if k < len(x) for y in (x[:k], x[-k:])}
        yield from ((min(i, j), max(i, j)) for y in parts for j in by_text.get(y, ()) for i in own)
    short = [x for x in by_text if len(x) <= CHARS]
    long_ = [x for x in by_text if len(x) > CHARS]
    for x in long_:
        for y in by_text:
            if y != x and (by_text[x][0] < left or by_text[y][0] < left) and abs(len(x) - len(y)) <= 4 and distance(x, y) <= 4:
                yield from ((min(i, j), max(i, j)) for i in by_text[x] for j in by_text[y])
    if len(short) < 2:
        return
    codes = np.ascontiguousarray(np.array(short, f"U{CHARS}")).view(np.uint32).reshape(len(short), CHARS)
    letters, flat = np.unique(codes, return_inverse=True)
    codes = np.where(codes > 0, flat.reshape(codes.shape) + 2, 0).astype(np.uint16)
    lengths = (codes > 0).sum(1).astype(np.int16)
    counts = np.stack([(codes == c + 2).sum(1) for c in range(len(letters)) if letters[c]]).astype(np.int16)
    rows = max(1, int(lengths.max()))
    step = max(1, BLOCK // len(short))
    for lo in range(0, sum(by_text[x][0] < left for x in short), step):  # the texts are in the order of their first number
        part = slice(lo, lo + step)
        # letters that one has more often than the other: each edit changes at most one
        bag = abs(lengths[part, None] - lengths[None])
        for c in counts:
            bag = bag + abs(c[part, None] - c[None])
        u, v = np.nonzero(bag <= 8)
        u, v = u[u + lo < v] + lo, v[u + lo < v]
        for at in range(0, len(u), 20_000):
            i, j = u[at : at + 20_000], v[at : at + 20_000]
            near = distances(codes[i, :rows].T, codes[j, :rows].T, lengths[i], lengths[j]) <= 4
            for x, y in zip(i[near].tolist(), j[near].tolist()):
                yield from ((min(m, n), max(m, n)) for m in by_text[short[x]] for n in by_text[short[y]])


def links_of_key(number: np.ndarray, name: np.ndarray, seq: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seq_a, seq_b): for each row of one key of the NEAR kind its first same node, if that is earlier."""
    first: dict[str, dict[str | None, int]] = {}  # the first node of each number and name
    for x, w, s in sorted(zip(number[node], name[node], seq[node].tolist()), key=lambda r: r[2]):
        first.setdefault(x, {}).setdefault(w, s)
    rows: dict[str, dict[str | None, list[int]]] = {}
    for x, w, s in zip(number, name, seq.tolist()):
        rows.setdefault(x, {}).setdefault(w, []).append(s)
    numbers = list(rows)
    best: dict[tuple[str, str | None], int] = {}

    def see(x: str, y: str, alike: bool | None) -> None:
        """Nodes of x become the first of rows of y."""
        nodes = first.get(x)
        if alike is False or not nodes:
            return
        least = min(nodes.values())
        for w in rows[y]:
            if alike is None:
                least = min((s for v, s in nodes.items() if names_alike(v, w)), default=None)
            if least is not None:
                best[y, w] = min(least, best.get((y, w), least))

    for x in numbers:
        if CUT.match(x):
            see(x, x, None)
    for i, j in candidates(numbers):
        alike = numbers_alike(numbers[i], numbers[j])
        see(numbers[i], numbers[j], alike)
        see(numbers[j], numbers[i], alike)
    pairs = [(s, t) for (y, w), s in best.items() for t in rows[y][w] if s < t]
    return tuple(np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2


def same_record(kind: int, x: str, y: str, name_x: str | None, name_y: str | None) -> bool:
    """The exact rerank of two records with one key."""
    if kind == NUMBER or x == y:
        return x == y and (kind == NUMBER or (bool(CUT.match(x)) and names_alike(name_x, name_y)))
    alike = numbers_alike(x, y)
    return alike is True or (alike is None and names_alike(name_x, name_y))


OUT = "field string, seq_a bigint, seq_b bigint"
NUMBER, NEAR = 0, 1


def _search_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    del parts
    for (field, kind), g in rows.groupby(["field", "kind"], sort=True):
        yield from _search_group(field, int(kind), g.sort_values("seq", kind="stable"))


def _search_group(field: str, kind: int, g: pd.DataFrame) -> Iterator[pd.DataFrame]:
    number, key = g["number"].to_numpy(object), g["key"].to_numpy(np.int64)
    name, seq = g["name"].to_numpy(object), g["seq"].to_numpy(np.int64)
    node = g["node"].to_numpy(bool)
    v = _vectors_of(g, kind)
    shards = Shards(1e-3 if kind == NUMBER else 0.1, key)
    out_a, out_b = [], []
    keys, code, size = np.unique(key, return_inverse=True, return_counts=True)
    for k in np.nonzero(size > LARGE)[0]:
        at = np.nonzero(code == k)[0]
        if kind == NEAR:
            a, b = links_of_key(number[at], name[at], seq[at], node[at])
            out_a += a.tolist()
            out_b += b.tolist()
        else:
            first: dict[str, int] = {}
            for i in at:  # in order of arrival
                if number[i] in first:
                    out_a.append(first[number[i]])
                    out_b.append(seq[i])
                elif node[i]:
                    first[number[i]] = seq[i]
    rest = np.nonzero(size[code] <= LARGE)[0]
    for lo in range(0, len(rest), SEGMENT):
        part = rest[lo : lo + SEGMENT]
        if node[part].any():
            shards.add(part[node[part]], v[part[node[part]]])
        for a, b in shards.search(part, v[part]):
            a = part[a]
            ok = (seq[b] < seq[a]) & (key[b] == key[a])
            for later, earlier in zip(a[ok], b[ok]):
                if same_record(kind, number[earlier], number[later], name[earlier], name[later]):
                    out_a.append(seq[earlier])
                    out_b.append(seq[later])
    if out_a:
        yield pd.DataFrame({"field": field, "seq_a": out_a, "seq_b": out_b})


KEYED = ("field", "kind", "seq", "number", "key", "cents", "minute", "name")
TRUNCATED = r"^\d\.?\d*E\+?\d+$"  # a number that a spreadsheet rounded


def _keyed(records: DataFrame) -> DataFrame:
    """Each record once for its number and once for its amount and time; what a kind doesn't compare is NULL."""
    none = lambda kind: F.lit(None).cast(kind)
    exact = records.filter(~F.col("number").rlike(TRUNCATED)).select("field", F.lit(NUMBER).alias("kind"), "seq", "number", F.xxhash64("field", "number").alias("key"), none("long").alias("cents"), none("long").alias("minute"), none("string").alias("name"))
    near = records.filter(F.col("cents").isNotNull() & F.col("minute").isNotNull())
    return exact.unionByName(near.select("field", F.lit(NEAR).alias("kind"), "seq", "number", F.xxhash64("field", "cents", "minute").alias("key"), "cents", "minute", "name"))


def hot_keys(keyed: DataFrame) -> DataFrame:
    """(key, rows) of the keys with more than HOT rows. Key groups are counted first: few rows, whatever the data."""
    group = F.pmod(F.col("key"), F.lit(65_536)).cast("int")
    groups = keyed.select(group.alias("g")).groupBy("g").count().filter(F.col("count") > HOT).select("g")
    some = keyed.select("key", group.alias("g")).join(F.broadcast(groups), "g")
    return some.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > HOT)


def same_rows(records: DataFrame, partition_rows: int = 40_000) -> DataFrame:
    """(field, seq_a, seq_b): each row that is the same as an earlier one, with the first such row.

    ``records``: field, seq (order of arrival), number (one writing), cents, minute (NULL if unreadable), name;
    it is read several times and so should be a written table.
    """
    keyed = _keyed(records)
    rows = records.count()
    n = max(1, -(-2 * rows // partition_rows))
    hot = cut(hot_keys(keyed)) if rows > HOT else None  # a key can't have more rows than there are
    copies = None
    if hot is not None and not hot.isEmpty():
        # rows of a hot key that are alike in all that is compared are collapsed to their first row
        hot = F.broadcast(hot.select("key"))  # at most all rows / HOT keys
        alike = [c for c in KEYED if c != "seq"]
        part = keyed.join(hot, "key").withColumn("same", F.sha2(F.to_json(F.struct(*alike)), 256))
        firsts = cut(part.groupBy(*alike, "same").agg(F.min("seq").alias("seq_a"), F.ceil(F.count("*") / HOT).cast("int").alias("parts")))
        # rows go back to their first row in as many parts as their class has HOT rows
        large = F.broadcast(firsts.filter("parts > 1").select("same", "parts"))  # at most all rows / HOT classes
        salted = part.select("field", "same", F.col("seq").alias("seq_b")).join(large, "same", "left").withColumn("salt", F.pmod(F.xxhash64("seq_b"), F.coalesce("parts", F.lit(1))).cast("int"))
        copies = salted.drop("parts").join(firsts.select("same", "seq_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")), ["same", "salt"]).filter("seq_b > seq_a").select("field", "seq_a", "seq_b")
        firsts = firsts.drop("parts")
        left = cut(firsts.withColumnRenamed("seq_a", "seq").select(*KEYED))
        slices = left.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("slices"))
        left = left.join(F.broadcast(slices), "key").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        left = left.withColumn("node", F.pmod(F.xxhash64("seq"), F.col("slices")) == F.col("slice")).drop("slices")
        keyed = keyed.join(hot, "key", "left_anti").withColumns({"slice": F.lit(0), "node": F.lit(True)}).unionByName(left)
    else:
        keyed = keyed.withColumns({"slice": F.lit(0), "node": F.lit(True)})
    links = keyed.repartition(n, "key", "slice").drop("slice").mapInPandas(_search_partition, OUT)
    return first_of_class(links if copies is None else links.unionByName(copies))


def first_of_class(links: DataFrame) -> DataFrame:
    """Follows the links to the first row of each class; pointers are doubled until none moves."""
    parent = cut(links.groupBy("field", "seq_b").agg(F.min("seq_a").alias("seq_a")))
    while True:
        up = parent.select("field", F.col("seq_b").alias("seq_a"), F.col("seq_a").alias("top"))
        moved = parent.join(up, ["field", "seq_a"], "left")
        if moved.filter("top is not null").isEmpty():
            return parent.select("field", "seq_a", "seq_b")
        parent = cut(moved.select("field", "seq_b", F.coalesce("top", "seq_a").alias("seq_a")))


# ---------------------------------------------------------------- the index that is kept between runs

STORE_BUCKETS = 64
ROWS = "field string, kind int, bucket int, key bigint, number string, name string, seq bigint"
SHARD = "field string, kind int, bucket int, level int, rows bigint, key binary, seq binary, number array<string>, name array<string>, v binary, links binary, orders binary"


def _stored(field: str, kind: int, bucket: int, level: int, key, seq, number, name, v) -> dict:
    g = Shard(v)
    return {"field": field, "kind": kind, "bucket": bucket, "level": level, "rows": len(seq), "key": key.tobytes(), "seq": seq.tobytes(), "number": list(number), "name": list(name), "v": v.tobytes(), "links": g.links.tobytes(), "orders": np.stack(g.orders).tobytes()}


def _loaded(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Shard]:
    """(keys, seqs, numbers, names, graph) of a stored shard; its graph isn't built again."""
    v = np.frombuffer(r["v"], np.float32).reshape(-1, DIMS)
    g = Shard.__new__(Shard)
    g.v, g.links = v, np.frombuffer(r["links"], np.int32).reshape(len(v), -1)
    g.directions = np.random.RandomState(17).normal(size=(Shard.ORDERINGS, DIMS))
    g.orders = list(np.frombuffer(r["orders"], np.int64).reshape(Shard.ORDERINGS, -1))
    g.keys = [(v.astype(np.float64) @ d)[o] for d, o in zip(g.directions, g.orders)]
    return np.frombuffer(r["key"], np.int64), np.frombuffer(r["seq"], np.int64), np.array(list(r["number"]), object), np.array(list(r["name"]), object), g


def _against(kind: int, new: pd.DataFrame, v: np.ndarray, shard) -> list[tuple[int, int]]:
    """(seq_a, seq_b) of new rows that are the same as a row of a stored shard.

    Keys with more than LARGE rows of the shard are compared exactly, the others by a beam tuned on this batch, or
    by key where the shard is small or no beam is good enough.
    """
    keys, seqs, numbers, names, graph = shard
    key, number, name, seq = new["key"].to_numpy(np.int64), new["number"].to_numpy(object), new["name"].to_numpy(object), new["seq"].to_numpy(np.int64)
    here = np.isin(key, keys)
    at = np.flatnonzero(here)
    if not len(at):
        return []
    found = Shards(1e-3 if kind == NUMBER else 0.1, np.concatenate([keys, key]))
    found.levels.append((0, np.arange(len(keys)), graph, {}))
    values, size = np.unique(keys, return_counts=True)
    large = values[size > LARGE] if kind == NEAR else values[:0]
    out = []
    usual = at[~np.isin(key[at], large)]
    for a, b in found.search(len(keys) + usual, v[usual]) if len(usual) else ():
        for i, j in zip(usual[a], b):
            if keys[j] == key[i] and seqs[j] < seq[i] and same_record(kind, numbers[j], number[i], names[j], name[i]):
                out.append((int(seqs[j]), int(seq[i])))
    for k in large:
        mine, theirs = np.flatnonzero(key == k), np.flatnonzero(keys == k)
        texts = list(dict.fromkeys(number[mine])) + [x for x in dict.fromkeys(numbers[theirs]) if x not in set(number[mine])]
        n = len(set(number[mine]))
        rows_of: dict[str, list[int]] = {}
        for j in theirs:
            rows_of.setdefault(numbers[j], []).append(j)
        pairs = {(x, x) for x in texts[:n]} | {(texts[p], texts[q]) for i, j in candidates(texts, n) for p, q in ((i, j), (j, i)) if p < n}
        for x, y in pairs:
            for i in mine[number[mine] == x]:
                out += [(int(seqs[j]), int(seq[i])) for j in rows_of.get(y, ()) if seqs[j] < seq[i] and same_record(kind, y, x, names[j], name[i])]
    return out


class Index:
    """The accepted history in a folder that all executors share, as graph shards by batch.

    Records are spread over STORE_BUCKETS buckets of their keys. check() reads the shards of the buckets that a batch
    touches and nothing of the history's records; add() writes the batch's own shards; compact() merges shards of one level once
    FANOUT of them have gathered in a bucket. A manifest names the parts that count, so a part that was written
    by a job that failed, or merged into another, is never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        at = self._path(f"{self.folder}/manifest")
        return [r["value"] for r in self.spark.read.text(f"{self.folder}/manifest").collect()] if self._files.exists(at) else []

    def _publish(self, parts: list[str]) -> None:
        new, old = (self._path(f"{self.folder}/{x}") for x in ("manifest-new", "manifest"))
        self._files.delete(new, True)
        self.spark.createDataFrame([(p,) for p in parts], "value string").coalesce(1).write.text(f"{self.folder}/manifest-new")
        self._files.delete(old, True)
        self._files.rename(new, old)

    def shards(self) -> DataFrame:
        parts = self.parts()
        return self.spark.read.schema(SHARD).parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], SHARD)

    def _rows(self, records: DataFrame) -> DataFrame:
        bucket = F.pmod(F.col("key"), F.lit(STORE_BUCKETS)).cast("int").alias("bucket")
        return _keyed(records).select("field", "kind", bucket, "key", "number", "name", "seq", "cents", "minute")

    def check(self, records: DataFrame) -> DataFrame:
        """(field, seq_a, seq_b): each record of the batch that is the same as one before it, in the batch or the history, with the first."""

        def run(key, new: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
            field, kind = str(key[0]), int(key[1])
            new = new.sort_values("seq", kind="stable").assign(node=True)
            if not len(new):
                return pd.DataFrame({"field": [], "seq_a": [], "seq_b": []})
            v = _vectors_of(new, kind)
            found = [pair for _, r in shards.iterrows() for pair in _against(kind, new, v, _loaded(r))]
            own = [(a, b) for x in _search_group(field, kind, new) for a, b in zip(x["seq_a"], x["seq_b"])]
            return pd.DataFrame([(field, a, b) for a, b in found + own], columns=["field", "seq_a", "seq_b"])

        by = ["field", "kind", "bucket"]
        rows = self._rows(records)
        touched = self.shards().join(F.broadcast(rows.select(*by).distinct()), by, "left_semi")  # STORE_BUCKETS x 4 at most
        return first_of_class(rows.groupBy(*by).cogroup(touched.groupBy(*by)).applyInPandas(run, OUT))

    def add(self, batch: str, records: DataFrame) -> None:
        """Stores the shards of a batch; a batch that was added before is replaced."""

        def build(key: tuple, new: pd.DataFrame) -> pd.DataFrame:
            new = new.sort_values("seq", kind="stable")
            return pd.DataFrame([_stored(str(key[0]), int(key[1]), int(key[2]), 0, new["key"].to_numpy(np.int64), new["seq"].to_numpy(np.int64), new["number"], new["name"], _vectors_of(new, int(key[1])))])

        part = f"batch={batch}"
        rest = [p for p in self.parts() if p != part]
        self._rows(records).groupBy("field", "kind", "bucket").applyInPandas(build, SHARD).write.mode("overwrite").parquet(f"{self.folder}/{part}")
        self._publish([*rest, part])

    def compact(self) -> int:
        """Merges the shards of each bucket and level of which FANOUT have gathered; gives the number of parts left."""
        parts = self.parts()
        if len(parts) < FANOUT:
            return len(parts)

        def merge(key: tuple, old: pd.DataFrame) -> pd.DataFrame:
            rows = list(old.sort_values("level", kind="stable").to_dict("records"))
            out, level = [], 0
            while rows:
                here = [r for r in rows if r["level"] <= level]
                rows = [r for r in rows if r["level"] > level]
                if len(here) < FANOUT:
                    out += here
                else:
                    k, s, n, m, g = zip(*map(_loaded, here))
                    s, order = np.concatenate(s), np.argsort(np.concatenate(s), kind="stable")
                    rows.append(_stored(str(key[0]), int(key[1]), int(key[2]), level + 1, np.concatenate(k)[order], s[order], np.concatenate(n)[order], np.concatenate(m)[order], np.concatenate([x.v for x in g])[order]))
                level += 1
            return pd.DataFrame(out)

        part = f"merged={uuid.uuid4().hex[:12]}"
        self.shards().groupBy("field", "kind", "bucket").applyInPandas(merge, SHARD).write.parquet(f"{self.folder}/{part}")
        self._publish([part])
        for p in parts:
            self._files.delete(self._path(f"{self.folder}/{p}"), True)
        return 1


def _vectors_of(rows: pd.DataFrame, kind: int) -> np.ndarray:
    return vectors(rows["number"].to_numpy(object), rows["cents"].fillna(0).to_numpy(np.int64), rows["minute"].fillna(0).to_numpy(np.int64), np.full(len(rows), kind == NUMBER))


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbered invoices and payments as records, with ids."""
    pay, inv, batches = (table(spark, sf_dir, t) for t in ("payment", "invoice", "import_batch"))
    cents = F.round(F.col("amount") * 100).cast("long").alias("cents")
    pay = timed_payments(pay.filter(F.col("transaction_id") != "").select("id", "import_seq", "batch_id", "transaction_id", "transaction_time", "amount", "merchant_name"), batches)
    pay = pay.select(F.lit("payment.transaction_id").alias("field"), F.col("import_seq").alias("seq"), "id", "number", cents, F.when(F.col("sec") >= 0, F.floor(F.col("sec") / 60)).alias("minute"), F.col("merchant_name").alias("name"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") * 1440
    inv = with_number(inv.filter(F.col("invoice_number") != "").select("id", "import_seq", "invoice_number", "amount", "date"), "invoice_number")
    inv = inv.select(F.lit("invoice.invoice_number").alias("field"), F.col("import_seq").alias("seq"), "id", "number", cents, day.alias("minute"), F.lit(None).cast("string").alias("name"))
    return inv.unionByName(pay).filter("number <> ''")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cut(records_of(spark, sf_dir))
    same = same_rows(records.drop("id"))
    ids = records.select("field", "seq", "id")
    out = same.join(ids.withColumnsRenamed({"seq": "seq_a", "id": "id_a"}), ["field", "seq_a"]).join(ids.withColumnsRenamed({"seq": "seq_b", "id": "id_b"}), ["field", "seq_b"])
    return out.select("field", "id_a", "id_b")
