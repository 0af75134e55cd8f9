"""Bills with known shares, and sums that must be exact."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabsplit.operators import allocate, settle

ITEMS = "bill_id long, item_no long, item_id string, name string, qty long, unit_cents long, total_cents long"
CLAIMS = f"{ITEMS}, ord long, user_id string, mode string, claimed long, named boolean"
PEOPLE = "bill_id long, ord long, user_id string, user_name string"
PRINTED = "bill_id long, total_cents long, has_subtotal boolean, receipt_type string, receipt_value long, group_type string, group_value long"


def settled(spark, total=60_000, receipt=(None, None), group=(None, None), claims=None, price=18_000):
    first, second = (1, 1, "item-1", "One", 2, price, 2 * price), (1, 2, "item-2", "Two", 1, 24_000, 24_000)
    made = claims or [(*first, 0, "u0", "individual", 1, False), (*first, 1, "u1", "individual", 1, False), (*first, 2, "u2", "individual", 0, False), *((*second, k, f"u{k}", "shared", 0, True) for k in range(3))]
    frames = (
        spark.createDataFrame([first, second], ITEMS), spark.createDataFrame(made, CLAIMS),
        spark.createDataFrame([(1, k, f"u{k}", f"U{k}") for k in range(3)], PEOPLE), spark.createDataFrame([(1, total, True, *receipt, *group)], PRINTED),
    )
    rows = settle.settle_bills(*frames).orderBy("ord").collect()
    return [r.share_cents for r in rows], rows[0].bill_cents, rows[0].discount_cents


@pytest.mark.parametrize(
    ("case", "shares", "bill"),
    [
        ({}, [26_000, 26_000, 8_000], 60_000),
        ({"group": ("amount", 6_000)}, [23_400, 23_400, 7_200], 54_000),
        ({"total": 66_000, "group": ("percent", 10)}, None, 60_000),
        ({"group": ("amount", 500_000)}, [0, 0, 0], 0),
        ({"group": ("amount", 10_000)}, None, 50_000),
        ({"total": 63_000, "receipt": ("amount", 6_000)}, [27_300, 27_300, 8_400], 63_000),
        ({"total": 63_000, "receipt": ("percent", 10)}, [27_300, 27_300, 8_400], 63_000),
        ({"total": 63_000, "receipt": ("amount", 6_000), "group": ("amount", 3_000)}, None, 60_000),
        ({"total": 0, "receipt": ("percent", 150)}, [0, 0, 0], 0),
    ],
)
def test_shares_of_known_bills(spark, case, shares, bill):
    found, total, _ = settled(spark, **case)
    assert total == bill and sum(found) == bill and min(found) >= 0
    assert shares is None or found == shares


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(1, 9)), min_size=1, max_size=8))
def test_even_splits_add_up(spark, groups):
    rows = [(g, k, total) for g, (total, n) in enumerate(groups) for k in range(n)]
    found = allocate.split_even(spark.createDataFrame(rows, "g long, k long, total long"), ["g"], "total", "k").collect()
    for g, (total, n) in enumerate(groups):
        shares = [r.share_cents for r in sorted(found, key=lambda r: r.k) if r.g == g]
        assert sum(shares) == total and max(shares) - min(shares) <= 1 and shares == sorted(shares, reverse=True) and len(shares) == n


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.lists(st.integers(0, 60), min_size=1, max_size=6)), min_size=1, max_size=6))
def test_capped_quantities_never_exceed_the_item(spark, groups):
    rows = [(g, k, q, qty) for g, (qty, qs) in enumerate(groups) for k, q in enumerate(qs)]
    found = allocate.cap_quantities(spark.createDataFrame(rows, "g long, k long, q long, qty long"), ["g"], "q", "qty", "k").collect()
    for g, (qty, qs) in enumerate(groups):
        assert sum(r.capped for r in found if r.g == g) == min(qty, sum(qs))
