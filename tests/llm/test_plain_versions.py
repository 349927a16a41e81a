"""Mixing and packing against plain computations."""

import math
import random
from collections import Counter, deque

import numpy as np

from quarrion.llm import mixing, packing


def test_dual_and_rounding(spark):
    """Each source's multiplier by bisection, and the threshold of one copy more by trying all."""
    r = random.Random(7)
    rows = [(k, "w " * r.choice([0, 1, 3, 40, 300]), r.choice(["a", "a", "a", "b", "c", None])) for k in range(900)] + [(2000 + k, "only " * 7, "tiny") for k in range(3)]
    sizes = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    state = {x["_key"]: x for x in mixing.plan(sizes).collect()}
    placed = [x for x in mixing._rounded(sizes, mixing.plan(sizes)).select("_key", "_size", "_rate", "_base", "_bucket").collect()]
    for key, s in state.items():
        own = [(x["_size"], x["_rate"], x["_base"], x["_bucket"]) for x in placed if x["_key"] == key]
        total = sum(n for n, *_ in own)
        assert s.source_size == total
        mean = max(total / len(own), 1.0)

        def words(lam, own=own, mean=mean):
            return sum(n * min(3.0, math.exp(min(lam * n / mean, 50))) for n, *_ in own)

        if 0 < s.target < 3 * total:
            lo, hi = -200.0, 200.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if words(mid) < s.target else (lo, mid)
            assert abs(words(s.lam) - s.target) <= 1e-5 * s.target and abs(s.lam - lo) < 1e-3 * max(1, abs(lo))
            for n, rate, base, bucket in own:
                assert abs(rate - min(3.0, math.exp(s.lam * n / mean))) < 1e-9 and base == math.floor(rate) and 0 <= bucket <= mixing.BUCKETS
        sure = sum(n * b for n, _, b, _ in own)
        tried = {m: abs(sure + sum(n for n, _, _, k in own if k < m) - s.target) for m in range(mixing.BUCKETS + 1)}
        assert abs(tried[s.more] - min(tried.values())) < 1e-6
    shares = {k: s.target for k, s in state.items()}
    assert abs(sum(shares.values()) - sum(s.source_size for s in state.values())) < 1e-6 * sum(shares.values())


def test_many_sources(spark):
    """Ranks over ranges of sources are those of a sort, and the level is that of a plain filling."""
    r = random.Random(3)
    rows = [(f"=s{k:04d}" if k else "~", r.choice([0, 1, 5, 1000])) for k in range(700)]
    t = {x["_key"]: x for x in mixing.targets(spark.createDataFrame(rows, "_key string, _size long").repartition(5)).collect()}
    size = dict(rows)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(size, key=lambda k: (k == "~", k)))}
    left, rest, want = float(sum(size.values())), set(size), {}
    while rest:
        level = left / sum(weight[k] for k in rest)
        full = {k for k in rest if weight[k] * level > 3 * size[k]}
        want |= {k: 3.0 * size[k] for k in full} if full else {k: weight[k] * level for k in rest}
        left -= sum(3 * size[k] for k in full)
        rest = rest - full if full else set()
    assert t.keys() == want.keys() and all(abs(t[k].target - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def plain_packing(queues, shares, deficits, first, length, piece):
    """One serving after another: (source, doc, start, n, sequence, offset)."""
    queues = {s: [[d, n, 0] for d, n in q] for s, q in queues.items() if q}
    order, turn, sequence, out = sorted(queues), 0, first, []
    while order:
        for s in order:
            deficits[s] += shares[s] * length
        at, skipped = 0, 0
        while at < length and order:
            turn %= len(order)
            s = order[turn]
            if deficits[s] <= 0:
                if skipped < len(order):
                    skipped += 1
                    turn += 1
                    continue
                s = max(order, key=lambda x: (deficits[x], x))
                turn = order.index(s)
            skipped = 0
            doc = queues[s][0]
            n = min(piece, length - at, doc[1] - doc[2])
            out.append((s, doc[0], doc[2], n, sequence, at))
            doc[2] += n
            at += n
            deficits[s] -= n
            if doc[2] == doc[1]:
                queues[s].pop(0)
                if not queues[s]:
                    order.remove(s)
                    continue
            turn += 1
        sequence += 1
    return out


def test_packing_schedule():
    r = random.Random(11)
    for trial in range(60):
        names = r.sample("abcdef", r.randint(1, 5))
        docs = {s: [(f"{s}{k}", r.choice([1, 2, 30, 255, 256, 257, 1024, 5000])) for k in range(r.randint(1, 12))] for s in names}
        shares = {s: r.random() for s in names}
        shares = {s: x / sum(shares.values()) for s, x in shares.items()}
        begin = {s: r.uniform(-800, 800) for s in names}
        ids = {d: np.full(n, i, "<u4") for i, (d, n) in enumerate(x for q in docs.values() for x in q)}
        one, two = dict(begin), dict(begin)
        want = plain_packing(docs, shares, one, trial, 1024, 256)
        got = list(packing.packed({s: deque((d, ids[d]) for d, _ in q) for s, q in docs.items()}, shares, two, trial, 1024, 256))
        merged = []
        for s, d, start, n, sequence, at in want:
            last = merged[-1] if merged else None
            if last and last[:2] == [s, d] and last[4] == sequence and last[2] + last[3] == start:
                last[3] += n
            else:
                merged.append([s, d, start, n, sequence, at])
        assert [[s, d, start, len(x), sequence, at] for d, start, x, _, sequence, at, s in got] == merged and one == two
        assert Counter(d for d, _, x, *_ in got for _ in range(len(x))) == Counter({d: n for q in docs.values() for d, n in q})
