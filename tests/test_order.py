"""Running totals and order statistics against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from tessera.cluster import Workspace
from tessera.operators import analytics, order


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), rng.randint(1, 9)) for i in range(700)] + [(1000 + i, "a", None) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(6)
    got = order.running(df, ["g", F.desc("k")], {"rank": F.lit(1), "total": F.col("v")}, Workspace(spark).keep).collect()
    want, total = [], 0
    for n, (k, g, v) in enumerate(sorted(rows, key=lambda r: (r[1], -r[0])), 1):
        total += v or 0
        want.append((k, g, v, n, total))
    assert sorted(map(tuple, got), key=lambda r: r[3]) == want
    assert order.running(df.limit(0), ["k"], {"rank": F.lit(1)}, Workspace(spark).keep).count() == 0
    whole = analytics.packed(df.filter("v is not null"), ["g", "k"], F.col("v"), 100)
    assert max(r.running for r in whole.collect()) <= 100 and whole.count() > 5


def test_order_statistics(spark):
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1)) for _ in range(5000)] + [("b", float(rng.randint(0, 3))) for _ in range(999)] + [("c", 7.0)] * 40 + [("d", None), (None, 1.0), (None, 2.0), ("e", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = order.middle() | {"p95": (0.95, F.floor(F.col("n") * F.lit(0.95))), "first": (0.0, F.lit(0)), "last": (1.0, F.col("n") - 1)}
    for accuracy in (50, 2000):
        got = {r.g: r for r in order.at_ranks(df, ["g"], "v", wanted, Workspace(spark).keep, accuracy).collect()}
        assert set(got) == {"a", "b", "c", None, "e"}
        for g, r in got.items():
            own = sorted(v for x, v in rows if x == g and v is not None)
            assert (r.lower + r.upper) / 2 == statistics.median(own) and r.n == len(own)
            assert (r.p95, r.first, r.last) == (own[int(len(own) * 0.95)], own[0], own[-1])
    all_ = order.at_ranks(df, [], "v", {"p95": (0.95, F.floor(F.col("n") * F.lit(0.95)))}, Workspace(spark).keep).collect()
    own = sorted(v for _, v in rows if v is not None)
    assert [(r.n, r.p95) for r in all_] == [(len(own), own[int(len(own) * 0.95)])]
    assert order.at_ranks(df.limit(0), ["g"], "v", order.middle(), Workspace(spark).keep).count() == 0
