"""Files that arrive, checked against what was stored before: the cross-batch rule as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.operators.records import new_numbers


BUCKETS = 256


def store_new(spark: SparkSession, arriving: str, store: str, checkpoint: str, schema: str, number: str, order: str):
    """A query that takes the Parquet files of a folder as they come and stores the rows whose number is new.

    Within a micro-batch the first row of a number in ``order`` counts. A batch that is run again after a
    failure overwrites its own folder, so nothing is stored twice. The store is kept in buckets of the number, of
    which a batch reads only those that its own numbers fall in, and of them only the numbers.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import Window as W

    bucket = F.pmod(F.xxhash64(number), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, batch_no: int) -> None:
        s = batch.sparkSession
        empty = F.coalesce(F.col(number), F.lit("")) == ""
        first = batch.withColumn("__n", F.when(empty, 1).otherwise(F.row_number().over(W.partitionBy(number).orderBy(order)))).filter("__n = 1").drop("__n").withColumn("bucket", bucket)
        folder = s._jvm.org.apache.hadoop.fs.Path(store)
        files = folder.getFileSystem(s._jsc.hadoopConfiguration())
        known = first.limit(0)
        if files.exists(folder):  # any other error than a missing store ends the query
            names = [x.getPath().getName() for x in files.listStatus(folder)]
            if any(x.startswith("batch=") and x != f"batch={batch_no}" for x in names):
                touched = [r[0] for r in first.select("bucket").distinct().collect()]  # BUCKETS numbers at most
                known = s.read.schema(f"{schema}, batch int, bucket int").parquet(store).filter((F.col("batch") != batch_no) & F.col("bucket").isin(touched)).select(*first.columns)
        new_numbers(first, known, number).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch_no}")

    stream = spark.readStream.schema(schema).parquet(arriving)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and time window of a stream or a table; later rows than ``late`` are dropped by a stream."""
    from pyspark.sql import functions as F

    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("bigint")).alias("cents")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "cents")
