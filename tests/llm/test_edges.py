"""Every query of the subpackage runs on hard rows and on empty tables."""

import pytest

from tallyweave.llm import queries


# what a row of a query is about: told at most once, however often rows repeat
ONCE = {
    "p2_found": ["field", "id_b"], "p3_found": ["field", "rec_id", "ride_index"], "p4_found": ["field", "rec_id"], "p5_found": ["field", "rec_id", "item_index"], "p7_found": ["invoice_id"], "p7_matches": ["payment_id"],
    "p10_found": ["doc_id", "line_no"], "p10_languages": ["doc_id", "line_no"], "p9_mix": ["doc_id", "epoch"], "p9_shares": ["source"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_hard_rows(spark, edge_dir, name):
    got = queries.queries()[name](spark, edge_dir)
    rows = got.collect()
    about = [tuple(r[c] for c in ONCE[name]) for r in rows] if name in ONCE else []
    assert got.columns and len(about) == len(set(about)) and not any(None in x for x in about)
    tables = {"rec_id": ("payment", "invoice", "hotel_standard"), "doc_id": ("documents",), "invoice_id": ("invoice",), "payment_id": ("payment",), "id_a": ("payment", "invoice"), "id_b": ("payment", "invoice")}
    for c in set(got.columns) & set(tables):
        known = set()
        for t in tables[c]:
            ids = spark.read.parquet(f"{edge_dir}/{t}.parquet")
            known |= {str(r[0]) for r in ids.select(next(x for x in ("id", "entry_id", "doc_id") if x in ids.columns)).collect()}
        assert {str(r[c]) for r in rows} <= known


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert queries.queries()[name](spark, empty_dir).count() == 0
