"""Sources mixed to target weights of the total size.

Weights are propagated through a tree domain - language - source. A leaf can give at most its tokens times
the repeats its source allows. What a leaf lacks goes first to the leaves of the same language in its
domain, then to the other languages of the domain, then to other domains, each time in proportion to the
weights of those that have room: shortages move to siblings before ancestors. Every leaf then takes its
budget as a prefix of tokens from seeded epochs: whole epochs, and of the last one the documents in the
order of a seeded hash until the budget is used.

The prefix needs no sort of a whole leaf: tokens are summed by (leaf, hash bucket), the running sum over
buckets finds the bucket in which the budget ends, and only the documents of that bucket are ranked.

Defined results: sources without a target are not drawn; a source without documents reaches 0 and its
share goes to the others; documents without tokens are never drawn. NULL or unusual languages form their
own leaf. Repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.llm.languages import NOTATIONS
from tallyweave.llm.tokens import TOKENIZER, token_counts
from tallyweave.tables import cut, few, table

# The domain of each source; others are their own domain. A parameter of mix().
DOMAINS = {
    "invoice_text": "bills", "bill_note": "bills", "hotel_folio": "bills", "toll_slip": "bills", "ride_sheet": "rides",
    "claim_memo": "office", "mail_thread": "office", "policy_note": "office", "fax_cover": "office",
}
BUCKETS = 4096


def language_of(label: Column) -> Column:
    """The language a label names, 'und' if none."""
    pairs = [F.lit(x) for lang, names in NOTATIONS.items() for form in names.split() for x in (form, lang)]
    key = F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-")[0]
    return F.coalesce(F.create_map(*pairs)[key], F.lit("und"))


def budgets(leaves: list[dict], total: float) -> dict[tuple, float]:
    """Tokens for each leaf (domain, lang, source) of (weight, cap); the leaves of a mix are few.

    Shortages are spread within (domain, lang), then within the domain, then overall.
    """
    got = {x["key"]: 0.0 for x in leaves}
    want = {x["key"]: x["weight"] * total for x in leaves}
    weight, cap = {x["key"]: x["weight"] for x in leaves}, {x["key"]: float(x["cap"]) for x in leaves}

    def pour(keys: list[tuple], amount: float) -> float:
        """Spreads an amount over the leaves with room by their weights; what is left over comes back."""
        while amount > 1e-6:
            room = [k for k in keys if cap[k] - got[k] > 1e-9 and weight[k] > 0]
            if not room:
                return amount
            all_weight = sum(weight[k] for k in room)
            step = min(1.0, *((cap[k] - got[k]) * all_weight / (weight[k] * amount) for k in room))
            for k in room:
                got[k] += step * amount * weight[k] / all_weight
            amount -= step * amount
        return 0.0

    lacking: dict[tuple, float] = {}
    for k in got:
        got[k] = min(want[k], cap[k])
        lacking[k] = want[k] - got[k]
    for depth in (2, 1, 0):
        groups: dict[tuple, list[tuple]] = {}
        for k in got:
            groups.setdefault(k[:depth], []).append(k)
        rest: dict[tuple, float] = {}
        for g, keys in groups.items():
            amount = sum(lacking.pop(k, 0.0) for k in keys)
            left = pour(keys, amount)
            if left:
                rest[keys[0]] = left
        lacking = rest
    return got


def mix(docs: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 42, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents drawn with their epoch, shares by source). ``docs`` has doc_id, lang, source, tokens.

    ``total`` is the size of the mix in tokens; "all" takes the tokens of all sources with a target, and what
    a source lacks others fill. By default it is the largest at which every source that has documents reaches
    its share, so the smallest source sets it; the queries use it only in p9_shares_even.
    """
    spark = docs.sparkSession
    domain = F.create_map(*[F.lit(x) for kv in (domains or DOMAINS).items() for x in kv])
    wanted = [r.asDict() for r in few(targets.select("source", "target_share", "max_repeat").filter("target_share > 0"))]  # one row a source
    shares = spark.createDataFrame([(w["source"], float(w["target_share"]), int(w["max_repeat"] or 1)) for w in wanted], "source string, target_share double, max_repeat int")
    rows = docs.filter("tokens > 0").join(F.broadcast(shares), "source").select("doc_id", F.coalesce(domain[F.col("source")], F.col("source")).alias("domain"), language_of(F.col("lang")).alias("lang"), "source", "tokens", "max_repeat")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 20), F.lit(BUCKETS)).cast("int"))
    leaf = ["domain", "lang", "source"]
    sums = rows.groupBy(*leaf, "max_repeat", "bucket").agg(F.sum("tokens").alias("tokens"))
    sums = cut(sums.coalesce(8))  # leaves x BUCKETS rows at most: sources with a target times known languages
    have = [r.asDict() for r in sums.groupBy(*leaf, "max_repeat").agg(F.sum("tokens").alias("tokens")).collect()]  # one row a leaf
    of_source: dict[str, int] = {}
    for h in have:
        of_source[h["source"]] = of_source.get(h["source"], 0) + h["tokens"]
    share = {w["source"]: w["target_share"] for w in wanted}
    all_shares = sum(share.values()) or 1.0
    leaves = [{"key": (h["domain"], h["lang"], h["source"]), "weight": share[h["source"]] / all_shares * h["tokens"] / of_source[h["source"]], "cap": h["tokens"] * h["max_repeat"]} for h in have]
    # a source without documents is a leaf that lacks everything: its share goes to its siblings
    leaves += [{"key": ((domains or DOMAINS).get(x, x), "und", x), "weight": share[x] / all_shares, "cap": 0} for x in share if x not in of_source]
    if total is None:
        size = min((x["cap"] / x["weight"] for x in leaves if x["cap"]), default=0.0)
    else:
        size = float(sum(of_source.values()) if total == "all" else total)
    got = budgets(leaves, size)
    plan = []
    for h in have:
        key = (h["domain"], h["lang"], h["source"])
        tokens = round(got[key])
        plan.append((*key, float(got[key]), int(tokens // h["tokens"]), float(tokens % h["tokens"])))
    plan_df = F.broadcast(spark.createDataFrame(plan or [(None,) * 6], "domain string, lang string, source string, budget double, epochs int, rest double"))

    # per bucket the tokens before and in it; the last epoch ends inside of one bucket of a leaf
    before = F.sum("tokens").over(W.partitionBy(*leaf).orderBy("bucket")) - F.col("tokens")
    ends = sums.withColumn("before", before).join(plan_df, leaf).select(*leaf, "bucket", "before", (F.col("before") + F.col("tokens")).alias("after"), "epochs", "rest")
    drawn = rows.join(F.broadcast(ends), [*leaf, "bucket"])
    edge = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    outside = drawn.filter(~edge).withColumn("times", F.col("epochs") + (F.col("after") <= F.col("rest")).cast("int"))
    upto = F.col("before") + F.sum("tokens").over(W.partitionBy(*leaf, "bucket").orderBy("order", "doc_id"))
    inside = drawn.filter(edge).withColumn("upto", upto).withColumn("times", F.col("epochs") + (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int")).drop("upto")
    often = outside.unionByName(inside).filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    result = often.select("doc_id", "domain", "lang", "source", "epoch", "tokens")
    return result, shares


def _sizes(spark: SparkSession, sf_dir: str, tokenizer_path: str) -> DataFrame:
    return cut(token_counts(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), tokenizer_path))


def p9_mix(spark: SparkSession, sf_dir: str, tokenizer_path: str = TOKENIZER) -> DataFrame:
    return mix(_sizes(spark, sf_dir, tokenizer_path), table(spark, sf_dir, "mix_target"), "all")[0]


def p9_shares_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a mix as large as all sources with a target together."""
    return p9_shares(spark, sf_dir, total="all")


def p9_shares_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the largest mix in which every source with documents reaches its share."""
    return p9_shares(spark, sf_dir, total=None)


def p9_shares(spark: SparkSession, sf_dir: str, tokenizer_path: str = TOKENIZER, total: int | str | None = "all") -> DataFrame:
    """Target and reached share of every source with a target, its tokens, and its repeats."""
    sizes = _sizes(spark, sf_dir, tokenizer_path)
    drawn, shares = mix(sizes, table(spark, sf_dir, "mix_target"), total)
    got = drawn.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), (F.max("epoch") + 1).alias("epochs"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("documents"))
    out = F.broadcast(shares).join(have, "source", "left").join(got, "source", "left").na.fill(0, ["source_tokens", "documents", "drawn_tokens", "epochs"])
    whole = F.sum("drawn_tokens").over(W.partitionBy())  # one row a source
    return out.select("source", "target_share", "max_repeat", "documents", "source_tokens", "drawn_tokens", "epochs", (F.col("drawn_tokens") / F.greatest(whole, F.lit(1))).alias("reached_share"))
