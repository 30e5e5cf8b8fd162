"""The input tables with hard rows: NULL in every column, very long and empty texts, repeated rows, and extra
columns whose names clash with those that operators use inside; and the same tables empty."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

IDS = {"payment": ["id", "import_seq"], "invoice": ["id", "import_seq"], "trip": ["id"], "import_batch": ["batch_id"], "hotel_standard": ["entry_id"], "raw_records": ["raw_id"], "documents": ["doc_id"]}
FIXED = ("place_ref", "known_names", "mix_target", "pack_capacity", "import_batch")
CLASHING = ("key", "value", "seq", "name_", "clean", "block", "tokens", "n", "slice", "utc_sec", "restored", "field", "rec_id", "number_", "cents", "kind_", "ch", "pos", "side", "nh")
LONG = "很长的文本 lang text. " * 20_000


def _bare(df, ids, make):
    """One row in which every column but the ids is made by ``make(field)``."""
    one = df.limit(1)
    for f in df.schema:
        if f.name in ids:
            kind = f.dataType.simpleString()
            one = one.withColumn(f.name, F.concat(F.lit("edge-"), F.lit(str(make.__name__))).cast(kind) if kind == "string" else (F.lit(9_000_000 + len(make.__name__)).cast(kind)))
        else:
            one = one.withColumn(f.name, make(f).cast(f.dataType))
    return one


def null(f):
    return F.lit(None)


def emptiness(f):
    return F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(None)


def endless(f):
    return F.lit(LONG) if isinstance(f.dataType, T.StringType) and f.name not in ("batch_id", "source", "claim_id", "category") else F.col(f.name)


def write_edge(spark, data, out):
    for p in sorted(os.listdir(data)):
        name = p.removesuffix(".parquet")
        df = spark.read.parquet(f"{data}/{p}")
        if name in IDS and name not in FIXED:
            part = df.orderBy(*IDS[name]).limit(60)
            again = part.limit(20)
            for c in IDS[name]:
                kind = df.schema[c].dataType.simpleString()
                again = again.withColumn(c, F.concat(F.col(c), F.lit("x")) if kind == "string" else (F.col(c) + 5_000_000).cast(kind))
            part = part.unionByName(again)
            for make in (null, emptiness, endless):
                part = part.unionByName(_bare(df, IDS[name], make))
            df = part
        for c in CLASHING:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.coalesce(2).write.parquet(f"{out}/{p}")
    return out


def write_empty(spark, data, out):
    for p in sorted(os.listdir(data)):
        spark.read.parquet(f"{data}/{p}").limit(0).coalesce(1).write.parquet(f"{out}/{p}")
    return out
