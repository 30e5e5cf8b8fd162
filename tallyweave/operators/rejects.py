"""Statement lines that fail to parse: split from the loading rows, with the reason.

Each worker writes the lines of an Arrow batch to scratch files of the task and lets DuckDB's strict CSV
reader load them with reject tables; the reader's line-level errors are joined to the raw records by file and line
number, and the values of the rows that loaded are then checked. A line break inside a record is written as a
noncharacter, so one record is one line. A record whose last quote may stay open has a file of its own, so that it
can't swallow its neighbours; the reader judges it like the others.

The reader lets three things pass that the format forbids, and they are checked on the raw line afterwards: a quote
inside an unquoted field, other signs than blanks beside a quoted field, and an empty field too many at the end. It names only
one error of a line, so a line with a wrong number of columns is also checked for its quoting, which counts first.

Defined results: NULL, blank and ``-`` lines, and lines before a file's header (or of a file without one),
are no records. Repeated lines are each reported. Empty tables give no rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.tables import table

FIELDS = 12
HEADER = "交易时间,"
# line feed, carriage return and NUL inside a record, as they are written to the scratch file
STAND_INS = {"\n": "﷐", "\r": "﷑", "\0": "﷒"}
BLANK = r"[\s\x{a0}\x{3000}\x{fdd0}\x{fdd1}]"
_QUOTED = r'"(?:[^"]|"")*"'
WELL_QUOTED = rf'(?:{BLANK}*{_QUOTED}{BLANK}*|[^",]*)(?:,(?:{BLANK}*{_QUOTED}{BLANK}*|[^",]*))*'
CLOSED = rf'(?: *{_QUOTED}[^,"]*| *[^", ][^,]*| *)(?:,(?: *{_QUOTED}[^,"]*| *[^", ][^,]*| *))*'
TIME = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2}) (?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?"
AMOUNT = r"[¥￥]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{1,2})?"
CONTROL = r"[\x00-\x1f\x7f\x{80}-\x{9f}\x{fffd}\x{fdd0}-\x{fdd2}]"
COLUMNS = [f"f{i}" for i in range(1, FIELDS + 1)]
OUT = "raw_id bigint, reason string, trade_time timestamp_ntz, category string, merchant string, amount double, direction string, method string, status string, trade_id string"

_CHECK = f"""
with errors as (
  select p.n, bool_or(error_type like '%QUOTE%') as quoting, bool_or(error_type like '%COLUMN%') as columns, count(*) as errors
  from reject_errors e join reject_scans s using (scan_id, file_id) join placed p on p.file = parse_filename(s.file_path) and p.line = e.line group by all
), lines as (
  select n, raw_id, regexp_full_match(line, ?) as quoted, length(regexp_replace(line, '{_QUOTED}|[^,"]', '', 'g')) + 1 as width from batch
), checked as (
  select l.raw_id, r.*, trim_(r.f1) as t, trim_(r.f3) as m, trim_(r.f7) as a, coalesce(e.errors, 0) as errors,
         case when coalesce(e.quoting, false) or not l.quoted then 'quoting'
              when coalesce(e.columns, false) or r.n is null or l.width <> {FIELDS} then 'column_count' end as broken
  from lines l left join loaded r on r.n = l.n left join errors e on e.n = l.n
)
select raw_id,
  case when broken is not null then broken
       when not coalesce(regexp_full_match(t, '{TIME}') and (regexp_full_match(split_part(t, ' ', 1), '[0-9]+-[0-9]+-[0-9]+') or regexp_full_match(split_part(t, ' ', 1), '[0-9]+/[0-9]+/[0-9]+'))
            and try_cast(replace(split_part(t, ' ', 1), '/', '-') as date) is not null, false) then 'transaction_time'
       when not coalesce(regexp_full_match(a, '{AMOUNT}'), false) then 'amount'
       when coalesce(m, '') = '' or regexp_matches(m, '{CONTROL}') then 'merchant_name' end as reason,
  try_cast(replace(t, '/', '-') as timestamp) as trade_time, trim_(f2) as category, m as merchant,
  try_cast(regexp_replace(a, '[¥￥,]', '', 'g') as double) as amount,
  trim_(f6) as direction, trim_(f8) as method, trim_(f9) as status, trim_(f10) as trade_id, errors
from checked
"""


def check_batch(con, raw_ids: list[int], lines: list[str], folder: str) -> pa.Table:
    """One batch through the reader: (raw_id, reason or NULL, typed columns, errors that the reader reported)."""
    swapped = []
    for x in lines:
        for a, b in STAND_INS.items():
            if a in x:
                x = x.replace(a, b)
        swapped.append(x)
    batch = pa.table({"n": pa.array(range(len(swapped)), pa.int64()), "raw_id": pa.array(raw_ids, pa.int64()), "line": pa.array(swapped, pa.string())})
    con.register("batch", batch)
    closed = next(iter(con.execute("select regexp_full_match(line, ?) from batch order by n", [CLOSED]).fetchnumpy().values()))
    files, placed, at = ["all.csv"], [], 0
    with open(os.path.join(folder, files[0]), "w", encoding="utf-8", newline="") as f:
        for n, (x, ok) in enumerate(zip(swapped, closed)):
            if ok:
                at += 1
                f.write(f"{n},{x}\n")
                placed.append((files[0], at, n))
            else:
                files.append(f"{n}.csv")
                with open(os.path.join(folder, files[-1]), "w", encoding="utf-8", newline="") as own:
                    own.write(f"{n},{x}\n")
                placed.append((files[-1], 1, n))
    con.register("placed", pa.table(dict(zip(("file", "line", "n"), map(list, zip(*placed))))))
    con.execute("drop table if exists reject_errors; drop table if exists reject_scans")
    kinds = ", ".join(f"'{c}': 'varchar'" for c in ["n", *COLUMNS])
    con.execute(
        f"""create or replace temp table loaded as select * replace (cast(n as bigint) as n)
        from read_csv(?, header=false, auto_detect=false, delim=',', quote='"', escape='"', new_line='\\n', columns={{{kinds}}},
                      store_rejects=true, rejects_limit=0, strict_mode=true, null_padding=false, max_line_size=268435456)""",
        [[os.path.join(folder, x) for x in files if x != "all.csv" or at]],
    )
    got = con.sql(_CHECK, params=[WELL_QUOTED]).to_arrow_table()
    con.unregister("batch")
    con.unregister("placed")
    for x in files:
        os.remove(os.path.join(folder, x))
    return got


def connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    con.execute(rf"create macro trim_(x) as regexp_replace(regexp_replace(x, '^{BLANK}+', ''), '{BLANK}+$', '')")
    return con


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = None
    kinds = pa.schema([("raw_id", pa.int64()), ("reason", pa.string()), ("trade_time", pa.timestamp("us")), *[(c, pa.string()) for c in ("category", "merchant")], ("amount", pa.float64()), *[(c, pa.string()) for c in ("direction", "method", "status", "trade_id")]])
    with tempfile.TemporaryDirectory() as folder:
        for b in batches:
            if not b.num_rows:
                continue
            con = con or connect()
            got = check_batch(con, b.column(0).to_pylist(), b.column(1).to_pylist(), folder)
            yield from got.select(kinds.names).cast(kinds).to_batches()


def record_lines(raw: DataFrame) -> DataFrame:
    """The lines of each file after its header that are records. The headers are pre-aggregated: one row a file."""
    heads = raw.filter(F.col("raw_line").startswith(HEADER)).groupBy("batch_id", "file_name").agg(F.min("line_no").alias("__head"))
    lines = raw.filter(F.col("raw_line").rlike(r"\S") & ~F.col("raw_line").startswith("-"))
    return lines.join(heads, ["batch_id", "file_name"]).filter(F.col("line_no") > F.col("__head")).drop("__head")


def load_records(raw: DataFrame) -> DataFrame:
    """All record lines typed, with the reason where they fail (NULL where they load)."""
    return record_lines(raw).select("raw_id", "raw_line").mapInArrow(_run, OUT)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_records(table(spark, sf_dir, "raw_records")).filter(F.col("reason").isNotNull()).select("raw_id", "reason")


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_records(table(spark, sf_dir, "raw_records")).filter(F.col("reason").isNull()).drop("reason")
