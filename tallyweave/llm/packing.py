"""Items put together into containers of fixed capacity.

An item larger than the capacity is cut into full pieces and a rest; nothing else is split. Full pieces
fill a container each. The other pieces are spread by hash over blocks of about ``BLOCK`` items, and each
block is packed by Karmarkar-Karp multiway differencing: of the partial partitions the two with the
largest spreads are merged, the fullest window of one with the emptiest of the other, until one partition
with near-equal windows is left. It starts with the least number of windows that the block's tokens need,
and the number rises whenever a window exceeds the capacity. Blocks hold a bounded number of items however
many documents there are, so no task grows with the data.

Defined results: items without tokens (NULL, empty) need no room and go in no container; ties are broken
by document id, so the result is the same in every run.
"""

from __future__ import annotations

import heapq
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.tokens import TOKENIZER, token_counts
from tallyweave.tables import cut, few, table

MOST_CAPACITIES = 1000  # kinds of containers, each of which takes all items
BLOCK = 400


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """The windows (sum, items) of Karmarkar-Karp differencing into k windows; empty ones are left out.

    A partial partition is the ascending list of its windows in use, the others are empty. Merging sets the
    fullest windows of one against the emptiest of the other: windows meet only where both have one in use.
    """
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-x, i, [(x, [i])]) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a = heapq.heappop(heap)
        _, _, b = heap[0]
        meet = len(a) + len(b) - k
        if meet > 0:
            both = [(x + y, i + j) for (x, i), (y, j) in zip(a[:meet], b[meet - 1 :: -1])]
            windows = both + a[meet:] + b[meet:]
        else:
            windows = a + b
        windows.sort(key=itemgetter(0))
        least = windows[0][0] if len(windows) == k else 0
        heapq.heapreplace(heap, (least - windows[-1][0], tie, windows))
    return heap[0][2] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most the capacity, as lists of item numbers.

    The window count starts with the least possible one and rises while a window exceeds the capacity: in
    doubling steps, then by halving between the last count that failed and the first that fits.
    """
    if not sizes:
        return []
    low = max(-(-sum(sizes) // capacity), sum(x * 2 > capacity for x in sizes), 1)
    fits = lambda windows: windows[-1][0] <= capacity
    failed, k, step = low - 1, low, max(1, low // 25)
    while True:
        if k >= len(sizes):
            k, best = len(sizes), [(x, [i]) for i, x in enumerate(sizes)]
            break
        best = differencing(sizes, k)
        if fits(best):
            break
        failed, k, step = k, k + step, 2 * step
    while k - failed > 1:
        mid = (k + failed) // 2
        tried = differencing(sizes, mid)
        if fits(tried):
            k, best = mid, tried
        else:
            failed = mid
    return [items for _, items in best]


def containers(sizes: DataFrame, capacities: DataFrame, block: int = BLOCK) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, token_from, tokens) of every piece of every item.

    ``sizes`` has doc_id and tokens, one row an item.
    """
    caps = few(capacities.select("container_kind", F.col("capacity_tokens").cast("long").alias("cap")).filter("cap > 0"), MOST_CAPACITIES)
    kinds = F.array(*[F.struct(F.lit(c["container_kind"]).alias("container_kind"), F.lit(c["cap"]).cast("long").alias("cap")) for c in caps])
    if not caps:
        kinds = F.array().cast("array<struct<container_kind: string, cap: bigint>>")
    pieces = sizes.filter("tokens > 0").select("*", F.inline(kinds))
    pieces = pieces.withColumn("full", F.floor(F.col("tokens") / F.col("cap"))).withColumn("rest", F.col("tokens") % F.col("cap"))
    whole = pieces.filter("full > 0").select("container_kind", "cap", "doc_id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece_no"))
    whole = whole.select("container_kind", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("cap")).alias("token_from"), F.col("cap").alias("tokens"))
    n = sizes.count()
    blocks = max(1, round(n / block))
    rest = pieces.filter("rest > 0").select("container_kind", "cap", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", F.col("full").cast("int").alias("piece_no"), (F.col("full") * F.col("cap")).alias("token_from"), F.col("rest").alias("tokens"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        at = np.empty(len(pdf), np.int64)
        for w, items in enumerate(pack(pdf["tokens"].tolist(), int(pdf["cap"].iloc[0]))):
            at[items] = w
        name = f"{pdf['container_kind'].iloc[0]}-{pdf['block'].iloc[0]}-"
        return pdf.assign(container_id=[name + str(w) for w in at])[["container_kind", "container_id", "doc_id", "piece_no", "token_from", "tokens"]]

    packed = rest.groupBy("container_kind", "block").applyInPandas(run, "container_kind string, container_id string, doc_id bigint, piece_no int, token_from bigint, tokens bigint")
    return whole.unionByName(packed)


def p8_containers(spark: SparkSession, sf_dir: str, tokenizer_path: str = TOKENIZER) -> DataFrame:
    sizes = cut(token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path))
    return containers(sizes, table(spark, sf_dir, "pack_capacity"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: how many there are, the tokens in them, and the share of the room used."""
    caps = table(spark, sf_dir, "pack_capacity").select("container_kind", "capacity_tokens")
    each = p8_containers(spark, sf_dir).groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return each.join(F.broadcast(caps), "container_kind").select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
