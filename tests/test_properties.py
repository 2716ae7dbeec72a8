"""Property tests: operators against plain-Python definitions on random inputs."""

from collections import Counter

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gavel.operators.diff import diff_by_time
from gavel.operators.running import running_frame
from gavel.operators.windows import q5_hot_items, q5_hot_items_by_window
from gavel.schema import BID

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 30), st.integers(1, 10**6)), min_size=1, max_size=120)


@SETTINGS
@given(rows=rows_st, last_k=st.sampled_from([None, 1, 2, 5]), parts=st.integers(1, 6))
def test_running_frame_property(spark, rows, last_k, parts):
    pdf = pd.DataFrame([(k, t, i, v) for i, (k, t, v) in enumerate(rows)], columns=["k", "t", "id", "v"])
    got = running_frame(spark.createDataFrame(pdf), ["k"], ["t", "id"], "v", last_k=last_k,
                        num_partitions=parts).collect()
    want = {}
    for k, grp in pdf.sort_values(["k", "t", "id"]).groupby("k"):
        vals = list(grp["v"])
        for j, rid in enumerate(grp["id"]):
            frame = vals[: j + 1] if last_k is None else vals[max(0, j + 1 - last_k): j + 1]
            want[rid] = (sum(frame), len(frame))
    assert {r.id: (r.frame_sum, r.frame_count) for r in got} == want


@SETTINGS
@given(a=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=30),
       b=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=30))
def test_diff_by_time_property(spark, a, b):
    schema = "t long, v long"
    got = Counter({(r.side, r.t, r.v): r.n_more for r in diff_by_time(
        spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "t").collect()})
    ca, cb = Counter(a), Counter(b)
    want = Counter({("left",) + k: n for k, n in (ca - cb).items()})
    want.update({("right",) + k: n for k, n in (cb - ca).items()})
    assert got == want


@SETTINGS
@given(bids=st.lists(st.tuples(st.integers(1, 6), st.integers(0, 40_000)), min_size=1, max_size=80),
       slices=st.integers(1, 5))
def test_q5_forms_agree(spark, bids, slices):
    ms = 1_000_000
    df = spark.createDataFrame([(a, 1, 1, t * ms) for a, t in bids], BID)
    size, slide = slices * 1000 * ms, 1000 * ms
    x = sorted(tuple(r) for r in q5_hot_items_by_window(df, size, slide).collect())
    y = sorted(tuple(r) for r in q5_hot_items(df, size, slide).collect())
    assert x == y and len(x) >= 1


auction_st = st.lists(st.tuples(st.integers(0, 20), st.integers(1, 20), st.integers(0, 50)),  # start, length, reserve
                      min_size=1, max_size=6)
bid_st = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 3), st.integers(0, 60), st.integers(0, 45)),
                  max_size=60)  # auction (may not exist), bidder, price, time


@SETTINGS
@given(auctions=auction_st, bids=bid_st)
def test_closed_auctions_property(spark, auctions, bids):
    from gavel.operators.closing import closed_auctions
    from helpers import auctions as mk_auctions, bids as mk_bids
    arows = [dict(id=i, t=s, exp=s + n, reserve=r, seller=100 + i, category=10 + i % 5)
             for i, (s, n, r) in enumerate(auctions)]
    want = {}
    for a in arows:
        valid = [(p, -t, -b, b, t) for (au, b, p, t) in bids
                 if au == a["id"] and p >= a["reserve"] and a["t"] <= t < a["exp"]]
        if valid:
            best = max(valid)
            want[a["id"]] = (a["category"], a["seller"], a["exp"], best[3], best[0], best[4])
    got = closed_auctions(mk_auctions(spark, arows), mk_bids(spark, bids)).collect()
    assert {r.auction: (r.category, r.seller, r.expires_ns, r.bidder, r.price, r.bid_time_ns)
            for r in got} == want
