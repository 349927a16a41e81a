import math
import random

from quarrion.operators import expand


def estimate(text):
    signs = sum(c in "{}()[];=<>" for c in text)
    return math.ceil(len(text) / (4.5 - min(signs / max(len(text), 1), 0.5) * 3))


def plain(files, terms, before, after, cap, total):
    """Request by request, file by file, line by line."""
    out, ask = [], {}
    for r, t, k in sorted((x for x in terms if x[1] is not None), key=lambda x: (x[2], x[1])):
        if len(ask.setdefault(r, [])) < expand.TERMS:
            ask[r].append(t[: expand.TERM_CHARS].lower())
    for r in sorted({f[0] for f in files}):
        mine = {}
        for _, p, k, text in sorted((f for f in files if f[0] == r), key=lambda f: (f[2], f[3] is None, f[3] or "")):
            mine.setdefault(p, (k, text))
        left = total
        for place, (p, (_, text)) in enumerate(sorted(mine.items(), key=lambda x: (x[1][0], x[0]))[: expand.PATHS]):
            status, content, used = None, "", 0
            if left <= 0:
                status = "left out"
            elif text is None:
                status = "missing"
            elif len(text.encode()) > expand.FILE_BYTES:
                status = "too large"
            else:
                lines = text.split("\n")
                hits = [i for i, x in enumerate(lines) if any(t in x.lower() for t in ask.get(r, []))]
                shown = sorted({j for i in hits for j in range(max(0, i - before), min(len(lines), i + after + 1))})
                status = "whole" if hits else "no match"
                for n, j in enumerate(shown):
                    more = (expand.GAP if n and shown[n - 1] < j - 1 else "") + lines[j][: expand.LINE_CHARS] + "\n"
                    if estimate(content + more) > min(cap, left):
                        status = "cut"
                        break
                    content += more
                used = estimate(content)
            left -= used
            out.append((r, p, place, status, content, used))
    return out


def test_expanded(spark):
    """Merged and separate windows, both budgets, and each status, against loops."""
    r = random.Random(4)
    text = lambda n: "\n".join(r.choice(["", "x = 1", "def Alpha(y):", "beta GAMMA here", "é ü ß", "z" * 30, "f(a)[0] = {};" * 3]) + (f" needle{r.randint(0, 3)}" if r.random() < 0.08 else "") for _ in range(n))
    files = [(q, f"f{k}", k, text(r.randint(1, 90))) for q in (1, 2, 3) for k in range(6)]
    files += [(4, f"g{k:02d}", 0, "needle1\n" * 3) for k in range(40)]  # more paths than count, in order of path
    files += [(5, "none", 0, None), (5, "large", 1, "needle0 " * 300_000), (5, "line", 2, "a\n" + "needle1" * 20_000), (5, "empty", 3, ""), (5, "twice", 4, "Needle1 b"), (5, "twice", 5, "other"), (6, "x", 0, "no terms were asked")]
    terms = [(q, f"NEEDLE{k}", k) for q in (1, 2, 3, 4, 5) for k in range(2)] + [(2, None, 0), (3, "é", 1), (3, "gamma", 2)] + [(1, f"unheard of {k}", 3) for k in range(70)] + [(1, "alpha", 4)]
    f, t = spark.createDataFrame(files, "request int, path string, k int, text string"), spark.createDataFrame(terms, "request int, term string, k int")
    seen = set()
    for before, after, cap, total in ((5, 5, 2000, 8000), (0, 2, 60, 150), (3, 0, 25, 40)):
        got = sorted((x.request, x.path, x.place, x.status, x.content, x.tokens) for x in expand.expanded(f, t, before, after, cap, total).collect())
        want = sorted(plain(files, terms, before, after, cap, total))
        assert [x[:4] for x in got] == [x[:4] for x in want]
        assert got == want
        seen |= {x[3] for x in got}
    assert seen == {"whole", "cut", "no match", "missing", "too large", "left out"}
    assert expand.expanded(f.limit(0), t).collect() == []
