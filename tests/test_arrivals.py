from tallyweave.operators import records
from tallyweave.plans import registry
from tests.conftest import DATA


def test_every_batch_is_checked_against_all_earlier_ones(spark):
    rows = [("a", "B1", 1, "7"), ("b", "B7", 2, "8"), ("c", "B8", 3, "8"), ("d", "B9", 4, "7"), ("e", "B9", 5, "9"), ("f", "B9", 6, "9"), ("g", "B8", 7, ""), ("h", "B9", 8, None), ("i", "B9", 9, None)]
    df = spark.createDataFrame(rows, "id string, batch_id string, import_seq bigint, invoice_number string")
    got = records.first_arrivals(df, "invoice_number", ["batch_id", "import_seq"], "id")
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "e", "g", "h", "i"]


def test_every_batch_new_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view invoice as select * from read_parquet('{DATA}/invoice.parquet')")
    want = sorted(con.execute(registry.oracle_sql()["q_every_batch_new"]).fetchall())
    assert sorted(map(tuple, registry.queries()["q_every_batch_new"](spark, DATA).collect())) == want


def test_store_takes_each_number_once_and_hides_no_error(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from tallyweave.streaming.arrivals import store_new

    schema = "id string, number string, pos int"
    put = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    run = lambda: store_new(spark, f"{tmp_path}/in/*", f"file://{tmp_path}/store", f"{tmp_path}/check", schema, "number", "pos").awaitTermination()
    put([("a", "1", 1), ("b", "1", 2), ("c", "", 3), ("d", None, 4)], 0)
    run()
    put([("e", "1", 5), ("f", "2", 6), ("g", "2", 7), ("h", "", 8)], 1)
    run()
    stored = spark.read.parquet(f"{tmp_path}/store")
    assert sorted(r["id"] for r in stored.collect()) == ["a", "c", "d", "f", "h"]
    (tmp_path / "store" / "batch=0" / "bucket=0").mkdir(exist_ok=True)
    for part in (tmp_path / "store" / "batch=0").rglob("*.parquet"):
        part.write_bytes(b"broken")
    put([("i", "1", 9), ("j", "2", 10)], 2)
    try:
        run()
        raise AssertionError("a store that can't be read must end the query")
    except StreamingQueryException:
        pass
