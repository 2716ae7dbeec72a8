"""Hand-made edge cases for the canonical meanings (FIXTURES.md section 5)."""

from helpers import auctions, bids, persons

from gavel.functions.time import NS_PER_HOUR, NS_PER_SECOND, NS_PER_US
from gavel.operators.averages import q4_category_avg, q4_running_avg, q6_last_avg
from gavel.operators.basic import q1_currency, q2_selection
from gavel.operators.closing import closed_auctions
from gavel.operators.joins import q3_local_items, q8_new_users
from gavel.operators.windows import q5_hot_items, q5_hot_items_by_window, q7_highest_bid

A = dict(id=1, reserve=5, t=10, exp=20)


def winner(spark, bid_rows, auction=A):
    out = closed_auctions(auctions(spark, [auction]), bids(spark, bid_rows)).collect()
    return [(r.price, r.bid_time_ns) for r in out]


def test_early_bid_before_auction_time_is_invalid(spark):
    assert winner(spark, [(1, 7, 9, 9)]) == []


def test_valid_bid_wins_regardless_of_arrival(spark):
    assert winner(spark, [(1, 7, 9, 12)]) == [(9, 12)]


def test_highest_of_two(spark):
    assert winner(spark, [(1, 7, 7, 12), (1, 8, 9, 13)]) == [(9, 13)]


def test_bid_at_start_valid_at_expiry_invalid(spark):
    assert winner(spark, [(1, 7, 9, 10)]) == [(9, 10)]
    assert winner(spark, [(1, 7, 9, 20)]) == []


def test_price_equal_to_reserve_is_valid(spark):
    assert winner(spark, [(1, 7, 5, 12)]) == [(5, 12)]


def test_tie_on_price_earliest_wins(spark):
    assert winner(spark, [(1, 7, 9, 12), (1, 8, 9, 11)]) == [(9, 11)]


def test_tie_on_price_and_time_lowest_bidder(spark):
    out = closed_auctions(auctions(spark, [A]), bids(spark, [(1, 8, 9, 12), (1, 7, 9, 12)])).collect()
    assert [r.bidder for r in out] == [7]


def test_no_valid_bid_no_row(spark):
    assert winner(spark, [(1, 7, 4, 12)]) == []


def _closed_series(spark, prices, key_col="bidder"):
    arows = [dict(id=i + 1, reserve=0, t=0, exp=100 + i, seller=1) for i in range(len(prices))]
    brows = [(i + 1, 5, p, 1) for i, p in enumerate(prices)]
    return closed_auctions(auctions(spark, arows), bids(spark, brows))


def test_q6_eleventh_price_drops_first(spark):
    closed = _closed_series(spark, list(range(1, 12)))
    out = q6_last_avg(closed, "bidder").orderBy("expires_ns").collect()
    assert [r.avg_price for r in out][-1] == sum(range(2, 12)) // 10 == 6
    assert [r.avg_price for r in out][:3] == [1, 1, 2]


def test_q4_integer_average(spark):
    closed = _closed_series(spark, [1, 2])
    assert [tuple(r) for r in q4_category_avg(closed).collect()] == [(10, 1)]
    assert [r.avg_price for r in q4_running_avg(closed).orderBy("expires_ns").collect()] == [1, 1]


def test_q1_truncates(spark):
    out = q1_currency(bids(spark, [(1, 1, 199, 0), (2, 1, 100, 0)])).collect()
    assert sorted(r.price for r in out) == [89, 177]


def test_q2_modulus(spark):
    out = q2_selection(bids(spark, [(123, 1, 5, 0), (124, 1, 6, 0), (246, 2, 7, 0)])).collect()
    assert sorted(tuple(r) for r in out) == [(123, 5), (246, 7)]


def test_window_boundary_goes_to_later_window(spark):
    out = q7_highest_bid(bids(spark, [(1, 1, 5, 10 * NS_PER_SECOND)]), "10 seconds").collect()
    assert [tuple(r) for r in out] == [(20 * NS_PER_SECOND, 5)]


def test_q5_tie_goes_to_higher_auction(spark):
    rows = [(a, 1, 1, NS_PER_SECOND * s) for a in (7, 9) for s in (1, 2, 3)]
    for fn in (q5_hot_items, q5_hot_items_by_window):
        out = fn(bids(spark, rows), "10 seconds", "10 seconds").collect()
        assert [(r.auction, r.n) for r in out] == [(9, 3)]


def test_q5_forms_agree_on_sliding_windows(spark):
    rows = [((i * 7) % 5, 1, 1, i * 333 * NS_PER_US * 1000) for i in range(300)]
    a = q5_hot_items(bids(spark, rows), "60 seconds", "1 second")
    b = q5_hot_items_by_window(bids(spark, rows), "60 seconds", "1 second")
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_q8_window_edges(spark):
    p = persons(spark, [(1, "OR", 0)])
    a = auctions(spark, [dict(id=10, t=12 * NS_PER_HOUR, exp=10**15, seller=1),
                         dict(id=11, t=12 * NS_PER_HOUR - NS_PER_US, exp=10**15, seller=1),
                         dict(id=12, t=-1, exp=10**15, seller=1)])
    out = q8_new_users(p, a).collect()
    assert [tuple(r) for r in out] == [(1, 11)]


def test_q3_filters(spark):
    p = persons(spark, [(1, "OR", 0), (2, "WA", 0)])
    a = auctions(spark, [dict(id=10, t=0, exp=1, seller=1), dict(id=11, t=0, exp=1, seller=2),
                         dict(id=12, t=0, exp=1, seller=1, category=11)])
    out = q3_local_items(a, p).collect()
    assert [r.auction_id for r in out] == [10]


def test_diff_by_time_multiset(spark):
    from gavel.operators.diff import diff_by_time
    a = spark.createDataFrame([(1, 5), (1, 5), (2, 7), (3, 1)], "t long, v long")
    b = spark.createDataFrame([(1, 5), (2, 7), (2, 8), (3, 1)], "t long, v long")
    got = sorted(tuple(r) for r in diff_by_time(a, b, "t").collect())
    assert got == [("left", 1, 5, 1), ("right", 2, 8, 1)]
    assert diff_by_time(a, a, "t").count() == 0


def test_diff_by_time_counts_a_row_that_differs_often(spark):
    from gavel.operators.diff import diff_by_time
    many = spark.range(50_000).selectExpr("1L AS t", "5L AS v")
    few = spark.createDataFrame([(1, 5)] * 3, "t long, v long")
    assert [tuple(r) for r in diff_by_time(few, many, "t").collect()] == [("right", 1, 5, 49_997)]
