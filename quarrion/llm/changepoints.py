"""Penalised change points: each vendor's daily series is cut where its variance changes, at the least total cost.

Rows are summed by vendor and day first (with map-side sums, so a vendor with a third of all rows sends a
row a day and task), and only days go on: applyInPandas gets one vendor's days and runs optimal partitioning over
them. Prefix sums of values and squares give the cost of every segment that ends on a day at once; the
day's best is the least (cost, segments) over all starts, ties to the earliest start, which is the backpointer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest days of a segment, cost of a cut, and what a unit of ln costs.
LEAST_DAYS, PENALTY, SCALE = 14, 40_000, 1000
#: Segments whose costs are computed at a time.
CELLS = 1 << 18
SCHEMA = "vendor_id long, segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def spreads(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 + floor of the variance, by exact integers."""
    return 1 + (n * q - s * s) // (n * n)


def costs(n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return n * np.floor(SCALE * np.log(spread.astype("f8"))).astype("i8")


def partition(x: np.ndarray, least: int = LEAST_DAYS, penalty: int = PENALTY) -> tuple[list[int], int]:
    """(starts of the best segments, their cost with penalties) of the values x, integers.

    Values whose squares could pass 64 bits are computed with unbounded integers. Quadratic in the length.
    """
    n = len(x)
    if n < least:
        least = n
    top = max(map(int, (abs(x.max()), abs(x.min()), 1)))
    kind = "i8" if n * n * top * top < 1 << 62 else object
    x = x.astype(kind)
    p, r = (np.concatenate([np.zeros(1, kind), np.cumsum(y)]) for y in (x, x * x))
    best, parts, back = np.full(n + 1, np.iinfo("i8").max >> 1, "i8"), np.zeros(n + 1, "i8"), np.zeros(n + 1, "i8")
    best[0] = -penalty  # the first segment pays no cut
    # Ends in blocks of at most `least`: the starts of a block's segments lie before the block.
    at = least
    while at <= n:
        ends = np.arange(at, min(at + min(least, max(1, CELLS // at)), n + 1))
        starts = np.arange(ends[-1] - least + 1)
        m = ends[:, None] - starts[None, :]
        fits = m >= least
        m = np.maximum(m, 1)
        wide = m if kind == "i8" else m.astype(object)
        v = spreads(wide, p[ends][:, None] - p[starts][None, :], r[ends][:, None] - r[starts][None, :])
        cost = costs(m, np.where(fits, v, 1))
        total = best[starts][None, :] + penalty + cost
        fits &= (starts == 0) | (starts >= least)
        order = np.where(fits, total * (n + 1) + parts[starts][None, :], np.iinfo("i8").max)
        back[ends] = k = order.argmin(axis=1)
        best[ends] = total[np.arange(len(ends)), k]
        parts[ends] = parts[k] + 1
        at = int(ends[-1]) + 1
    cuts, e = [], n
    while e:
        e = int(back[e])
        cuts.append(e)
    return cuts[::-1], int(best[n])


def _vendor(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
    """One vendor's segments; days(day, q), a row a day."""
    first = int(days["day"].min())
    x = np.zeros(int(days["day"].max()) - first + 1, "i8")
    x[days["day"].to_numpy() - first] = days["q"].to_numpy()
    starts, best = partition(x)
    ends = [*starts[1:], len(x)]
    out = []
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        part = [int(y) for y in x[a:b]]
        n, s = b - a, sum(part)
        spread = 1 + (n * sum(y * y for y in part) - s * s) // (n * n)
        out.append((i + 1, first + a, n, s, spread, int(costs(np.array([n]), np.array([spread], object))[0]), len(starts), best))
    got = pd.DataFrame(out, columns=["segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"])
    got.insert(0, "vendor_id", pd.array([None if key[0] is None or pd.isna(key[0]) else int(key[0])] * len(got), "Int64"))
    return got


def daily(lines: DataFrame) -> DataFrame:
    """vendor_id, day (since 1970) and q, the sum of quantity, of the rows that have quantity and shipped_at."""
    taken = lines.where(F.col("quantity").isNotNull() & F.col("shipped_at").isNotNull())
    day = F.unix_date(F.to_date("shipped_at")).cast("long")
    return taken.groupBy(F.col("vendor_id").cast("long").alias("vendor_id"), day.alias("day")).agg(F.sum(F.col("quantity").cast("long")).alias("q"))


def segments(lines: DataFrame) -> DataFrame:
    """vendor_id, segment_no, first_day, n_days, total, spread, cost, n_segments and best_cost of sale_lines(vendor_id, quantity, shipped_at).

    Rows without quantity or shipped_at don't count, repeated rows count as often as they stand there. A null vendor is a
    vendor of its own, with a null id. Days without rows, inside a series, count 0; a vendor without rows has no series;
    a series of under LEAST_DAYS days is one segment. Equal costs: fewest segments, then the earliest starts, from the last
    segment backwards. An empty table gives an empty result; other columns, also of the result's names, aren't read. A vendor's
    task holds its days, whatever its rows, and time grows with their square.
    """
    return daily(lines).groupBy("vendor_id").applyInPandas(_vendor, SCHEMA)
