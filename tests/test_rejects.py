import datetime
import re

from tallyweave.operators import rejects

HEAD = "交易时间,a,b"


def brute(x):
    fields, pos = [], 0
    pat = re.compile(r'\s*"((?:[^"]|"")*)"\s*(,|$)|([^",]*)(,|$)')
    while True:
        m = pat.match(x, pos)
        if not m:
            return "quoting"
        fields.append((m[1].replace('""', '"') if m[1] is not None else m[3]).strip())
        pos = m.end()
        if (m[2] if m[1] is not None else m[4]) == "":
            break
    if len(fields) != 12:
        return "column_count"
    try:
        m = re.fullmatch(r"(\d{4})([-/])(\d{1,2})\2(\d{1,2}) (\d{1,2}):(\d\d)(?::(\d\d))?", fields[0], re.ASCII)
        datetime.datetime(int(m[1]), int(m[3]), int(m[4]), int(m[5]), int(m[6]), int(m[7] or 0))
    except (TypeError, ValueError):
        return "transaction_time"
    if not re.fullmatch(r"[¥￥]?(\d+|\d{1,3}(,\d{3})+)(\.\d{1,2})?", fields[6], re.ASCII):
        return "amount"
    if not fields[2] or re.search("[\x00-\x1f\x7f-\x9f�]", fields[2]):
        return "merchant_name"
    return None


def line(time="2025-01-02 03:04", merchant="店", amount="1.00", tail=",,,,"):
    return f"{time},类,{merchant},x,y,支出,{amount},卡{tail}"


LINES = [
    line(), line("2025/1/2 3:04:05"), line("2025-1-2 24:00"), line("2025-02-30 01:00"), line("2025-01-02"), line(amount='"1,234.50"'), line(amount="1,234.50"), line(amount="¥12"), line(amount="+1"), line(amount="1.234"),
    line(amount=" 6 "), line(merchant=""), line(merchant="\t"), line(merchant='"a\nb"'), line(merchant='"a,b"'), line(merchant='"a""b"'), line(merchant='a"b'), line(merchant='"a"b'), line(merchant='"a'), line(merchant=' "a" '),
    line(merchant="a\x07"), line(merchant="a\x00b"), line(merchant="�"), line(tail=",,,"), line(tail=",,,,,"), line(tail=",,,,,x"), "", "   ", "----", "x", line(merchant='""'), line(merchant="长" * 100_000), line(), line(),
]


def test_against_brute_force(spark):
    rows = [(0, "b", "f", 1, "free"), (1, "b", "f", 2, HEAD)] + [(10 + k, "b", "f", 10 + k, x) for k, x in enumerate(LINES)] + [(900, "b", "f", 900, None), (901, "b", "g", 1, line(amount="bad"))]
    raw = spark.createDataFrame(rows, "raw_id bigint, batch_id string, file_name string, line_no int, raw_line string")
    got = {r["raw_id"]: r["reason"] for r in rejects.load_records(raw).collect()}
    want = {10 + k: brute(x) for k, x in enumerate(LINES) if x.strip() and not x.startswith("-")}
    assert got == want
    loaded = {r["raw_id"]: r["amount"] for r in rejects.load_records(raw).filter("reason is null").collect()}
    assert loaded[15] == 1234.5


def test_the_reader_judges_every_line(tmp_path):
    records = [x for x in LINES if x.strip() and not x.startswith("-")]
    got = rejects.check_batch(rejects.connect(), list(range(len(records))), records, str(tmp_path)).to_pydict()
    told = {x: (r, e) for x, r, e in zip((records[i] for i in got["raw_id"]), got["reason"], got["errors"])}
    assert told[line(merchant='"a')] == ("quoting", told[line(merchant='"a')][1]) and told[line(merchant='"a')][1] > 0  # its quote stays open
    assert told[line(tail=",,,")][1] > 0 and told[line(tail=",,,,,x")][1] > 0 and told[line(merchant='"a"b')][1] > 0
    assert told[line(merchant='a"b')] == ("quoting", 0) and told[line(tail=",,,,,")] == ("column_count", 0)  # what it lets pass
    assert all(r in ("quoting", "column_count") for r, e in told.values() if e) and not any(tmp_path.iterdir())
