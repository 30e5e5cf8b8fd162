"""Every registered core query runs on hard rows and on empty tables."""

import pytest

from tallyweave.plans import registry

GENERAL = ["p1_found", "p6_found", "p6_loaded", "p1_zone_tables"]
OTHERS = ["q_greedy_batches", "q_invoice_copies", "q_cross_batch_new", "q_classify", "q_extract_datetime", "q_document_amount", "q_document_rides", "q_ride_rows", "q_trip_of_invoice", "q_capital_amounts"]


@pytest.mark.parametrize("name", GENERAL + OTHERS)
def test_hard_rows(spark, edge_dir, name):
    got = registry.queries()[name](spark, edge_dir)
    rows = got.collect()
    about = {"p1_found": ["field", "rec_id", "ride_index"], "p6_found": ["raw_id"], "p6_loaded": ["raw_id"], "q_invoice_copies": ["id"], "q_classify": ["id"], "q_capital_amounts": ["id"], "q_ride_rows": ["id", "ride_no"]}.get(name)
    assert got.columns and (about is None or len({tuple(r[c] for c in about) for r in rows}) == len(rows))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"q_optimizer_generated", "q_footer"}))  # one generates its own rows, one gives totals
def test_empty_tables(spark, empty_dir, name):
    assert registry.queries()[name](spark, empty_dir).count() == 0
