import datetime
import math

import duckdb
import numpy as np

from quarrion.llm import changepoints, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["vendor_id", "segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]


def cost(x):
    n, s, q = len(x), sum(x), sum(y * y for y in x)
    return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))


def plain(x, least=14, penalty=40_000):
    """By trying every start for every end; a state is (cost, segments, starts from the last backwards)."""
    if len(x) < least:
        return [0], cost(x)
    best = {0: (0, 0, ())}
    for e in range(least, len(x) + 1):
        tries = [(best[k][0] + cost(x[k:e]) + penalty * (k > 0), best[k][1] + 1, (k, *best[k][2])) for k in best if e - k >= least]
        best[e] = min(tries)
    return list(best[len(x)][2][::-1]), best[len(x)][0]


def test_partition_by_trying_all():
    r = np.random.default_rng(5)
    made = [r.integers(0, 50, n) for n in (1, 5, 13, 14, 27, 28, 29, 61)]
    made += [np.concatenate([r.normal(100, s, k) for s, k in ((1, 20), (40, 25), (3, 31), (200, 18))]).astype(int) for _ in range(4)]
    made += [np.zeros(70, int), np.full(45, 7), np.tile([0, 10**6], 30), np.repeat([5, 900, 5], 20), np.repeat([0, 10**9 * 4], 20), -np.repeat([1, 50], 30)]
    made += [np.concatenate([np.zeros(30, int), r.integers(0, 9000, 30)] * 2)]
    for x in made:
        assert changepoints.partition(np.array(x, "i8")) == plain([int(y) for y in x])
    for least, penalty in ((1, 0), (2, 500), (5, 10**6)):
        for x in made[:8]:
            assert changepoints.partition(np.array(x, "i8"), least, penalty) == plain([int(y) for y in x], least, penalty)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def expected(lines):
    by = {}
    for v, q, t in lines:
        if q is not None and t is not None:
            d = (t.date() - datetime.date(1970, 1, 1)).days
            by.setdefault(v, {})
            by[v][d] = by[v].get(d, 0) + q
    out = []
    for v, days in by.items():
        first = min(days)
        x = [days.get(d, 0) for d in range(first, max(days) + 1)]
        starts, best = plain(x)
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(x)], strict=True)):
            n, s = b - a, sum(x[a:b])
            out.append((v, i + 1, first + a, n, s, 1 + (n * sum(y * y for y in x[a:b]) - s * s) // (n * n), cost(x[a:b]), len(starts), best))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_segments_with_odd_rows(spark):
    r = np.random.default_rng(8)
    at = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(d), hours=int(h))
    lines = [(1, int(q), at(d, h)) for d, q, h in zip(r.integers(0, 90, 400), r.integers(1, 50, 400), r.integers(0, 24, 400), strict=True)]
    lines += [(1, 40_000, at(d)) for d in range(40, 60)] * 2  # repeated rows count twice
    lines += [(2, 5, at(3, 23))] + [(3, None, at(1)), (3, 5, None)] + [(None, 5, at(d)) for d in (0, 20)] + [(None, None, None)]
    lines += [(4, 2**31 - 1, at(d)) for d in range(0, 60, 2)] + [(5, -3, at(1)), (5, 0, at(80))]
    df = spark.createDataFrame([(*x, 1, "y") for x in lines], "vendor_id long, quantity int, shipped_at timestamp_ntz, day int, total string")
    assert rows_of(changepoints.segments(df)) == expected(lines)
    assert changepoints.segments(df.limit(0)).collect() == []


def test_query(spark):
    """Against every start tried, and against SQL."""
    lines = [(r.vendor_id, r.quantity, r.shipped_at) for r in spark.read.parquet(f"{SF}/sale_lines.parquet").collect()]
    got = rows_of(queries.QUERIES["op12_change_points"](spark, SF))
    assert got == expected(lines) and len(got) > len({x[0] for x in got})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sale_lines AS SELECT * FROM read_parquet('{SF}/sale_lines.parquet')")
    rel = con.sql(queries.ORACLE["op12_change_points"])
    assert sorted(rel.select(*COLUMNS).fetchall()) == got
