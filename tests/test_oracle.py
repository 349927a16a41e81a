"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from quarrion.plans import graph_queries, rank_queries, scope_queries, search_queries, source_queries, upkeep_queries  # noqa: F401
from quarrion.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (int, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in rel.fetchall())
    assert sorted(names) == cols and got == want


def test_best_first_is_within_reach(spark):
    """The best-first expansion visits only what the level-wise one, without a cap, reaches."""
    from quarrion.operators import graph
    from quarrion.plans import corpus

    e, s = corpus.edges(spark, SF), graph_queries.seeds(spark, SF)
    every = {(r.prompt_id, r.node) for r in graph.expanded(e, s, 2, 1 << 30).collect()}
    some = [(r.prompt_id, r.node) for r in graph.expanded_exactly(e, s).collect()]
    assert some and set(some) <= every and len(some) == len(set(some))


def test_rotation(spark):
    """Against one user after another, a time after another; feedback by buckets against all pairs."""
    import random

    from quarrion.operators import memory

    h, r = 3_600_000, random.Random(7)
    rows = [("a", t * h) for t in (0, 1, 24, 25, 26, 60)] + [("b", 5), ("b", None), (None, 7)] + [("busy", r.randint(0, 900) * h // 3) for _ in range(400)] + [("c", -50 * h), ("c", -26 * h), ("c", -2 * h - 1)]
    want = []
    for u in ("a", "b", "busy", "c"):
        begin, k = None, -1
        for t in sorted(t for x, t in rows if x == u and t is not None):
            if begin is None or t - begin > 24 * h:
                begin, k = t, k + 1
                want.append((u, k, t))
    got = memory.rotated(spark.createDataFrame(rows, "user_id string, at long")).collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    one, two = ([(k, r.choice(["f", "f", "g", None]), at(r.randint(0, 3000))) for k in range(n)] for n in (80, 90))
    shape = "id long, key string, ts timestamp"
    found = memory.read_feedback_by_time(spark.createDataFrame([*one, (900, "f", None)], shape), spark.createDataFrame(two, shape)).collect()
    assert sorted(tuple(x) for x in found) == sorted((a, b) for a, x, s in one for b, y, t in two if x and x == y and 0 <= (t - s).total_seconds() <= 300)
