"""Top-k queries that need no stored index."""

import pytest

from quarrion.plans import corpus, search_queries  # noqa: F401
from quarrion.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["x2_bm25_topk", "o1_topk_by_blocks"])
def test_no_index_is_built(spark, monkeypatch, name):
    """A batch of prompts is ranked in passes over the texts; the oracle's test has the rows."""
    monkeypatch.setattr(corpus, "indexes", lambda *a: 1 / 0)
    assert QUERIES[name](spark, SF).count() > 0


def test_too_many_prompts_meet_the_index(spark, monkeypatch):
    from quarrion.operators import scan

    rows = lambda: sorted(map(tuple, QUERIES["x2_bm25_topk"](spark, SF).collect()))
    want = rows()
    monkeypatch.setattr(scan, "BROADCAST_ROWS", 5)
    assert rows() == want


def test_blocks_are_ruled_out(monkeypatch):
    """Blocks that can't reach a prompt's running k-th score aren't scored, for the same k best, ties included."""
    import numpy as np
    import pyarrow as pa

    from quarrion.operators import scan

    r, n, k = np.random.default_rng(3), 4000, 5
    monkeypatch.setattr(scan, "CELLS", 4000)
    monkeypatch.setattr(scan, "BLOCK", 16)
    held = [sorted(r.choice(30, r.integers(0, 8), replace=False)) if j % 50 else [1, 2, 3] for j in range(n)]
    tfs = [[float(x) for x in r.integers(1, 4, len(h))] if j % 50 else [1.0] * 3 for j, h in enumerate(held)]
    rows = {"view_id": list(r.choice(["a", "b"], n)), "id": [f"c{j:05d}" for j in range(n)], "dl": [int(x) for x in r.integers(1, 60, n)], "stems": held, "tfs": tfs}
    schema = pa.schema([("view_id", pa.string()), ("id", pa.string()), ("dl", pa.int64()), ("stems", pa.list_(pa.int32())), ("tfs", pa.list_(pa.float64()))])
    batches = [b for b in pa.Table.from_pydict(rows, schema).to_batches(max_chunksize=1500)] + [pa.RecordBatch.from_pylist([], schema)]
    pairs = [(p, int(s)) for p in range(20) for s in r.choice(30, r.integers(1, 7), replace=False)] + [(40, 1), (40, 2), (40, 3)]
    stats = [(v, s, float(x), 25.0) for v in "ab" for s, x in enumerate(np.random.default_rng(5).uniform(0.01, 6, 30))]
    seen, whole = [], scan._open
    monkeypatch.setattr(scan, "_open", lambda *a: seen.append(whole(*a)) or seen[-1])

    def best(blocks):
        found = {}
        for b in scan._best(pairs, stats, 30, k, 1.2, 0.75, ("any",), blocks)(iter(batches)):
            for x in b.to_pylist():
                found.setdefault(x["prompt_id"], []).append((-round(x["score"], 9), x["id"], x["view_id"], x["n_terms"]))
        return {p: sorted(x)[:k] for p, x in found.items()}

    want = best(False)
    assert not seen and best(True) == want and len(want) == 21
    assert 0 < sum(x.sum() for x, _ in seen) < 0.5 * sum(x.size for x, _ in seen)
