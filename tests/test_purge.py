import os

import pytest

from quarrion.sources import purge
from quarrion.sources.store import Store

VIEW = "view_id string, project_id string, worktree_id string, branch string, place string, state string, active boolean"
FACT = "fact_id string, scope string, scope_id string, provenance string, evidence array<struct<view_id:string>>"


def made(spark, tmp_path):
    """A store of two projects, p (views a, b, c) and q (view d), with a folder a view."""
    home = f"{tmp_path}/home"
    store = Store(spark, f"file://{tmp_path}/store")
    views = [(v, p, t, b, f"{home}/{p}/{v}", "ready", act) for v, p, t, b, act in [("a", "p", "t1", "main", True), ("b", "p", "t1", "old", False), ("c", "p", "t2", "main", True), ("d", "q", "t3", None, False)]]
    for v in views:
        os.makedirs(v[4])
        open(f"{v[4]}/x", "w").close()
    ev = lambda *vs: [(v,) for v in vs]
    facts = [("f1", "view", "a", "model", ev("a")), ("f2", "project", "p", "user", ev("a", "c")), ("f3", "group", "g", "user", ev("b")), ("f4", "project", "q", "model", ev("b", "d")), ("f5", "view", "d", None, None), ("f6", None, None, "user", ev("c"))]
    store.commit({
        "views": spark.createDataFrame(views, VIEW),
        "worktrees": spark.createDataFrame([("t1", "p", False, False), ("t2", "p", True, False), ("t3", "q", True, True)], "worktree_id string, project_id string, removed boolean, locked boolean"),
        "projects": spark.createDataFrame([("p",), ("q",)], "project_id string"),
        "memberships": spark.createDataFrame([("g", "p"), ("g", "q")], "group_id string, project_id string"),
        "edges": spark.createDataFrame([(1, "a", "c"), (2, "d", "a"), (3, "d", "d"), (4, None, "d")], "edge long, source_view_id string, target_view_id string"),
        "chunks": spark.createDataFrame([(v, k) for v in "abcd" for k in range(3)], "view_id string, k int"),
        "facts": spark.createDataFrame(facts, FACT),
        "settings": spark.createDataFrame([("x", 1)], "name string, value int"),
    })
    return store, home


def left(store, name, column):
    return sorted(r[0] for r in store.read(name).select(column).distinct().collect())


def test_actions(spark, tmp_path):
    """Worktrees that are gone but not locked; branches that are gone of views that aren't active, in projects whose branches are known."""
    store, _ = made(spark, tmp_path)
    branches = spark.createDataFrame([("p", "main")], "project_id string, branch string")
    got = purge.actions(store.read("views"), store.read("worktrees"), branches)
    assert sorted((r.kind, r.id, r.view_id) for r in got.collect()) == [("branch", "b", "b"), ("worktree", "t2", "c")]
    assert purge.actions(store.read("views"), store.read("worktrees"), branches.limit(0)).count() == 1


def test_cleanup(spark, tmp_path):
    store, home = made(spark, tmp_path)
    branches = spark.createDataFrame([("p", "main")], "project_id string, branch string")
    s = store.snapshot()
    purge.purge(store, home, purge.actions(s.read("views"), s.read("worktrees"), branches), 0)
    assert left(store, "views", "view_id") == ["a", "d"] and left(store, "worktrees", "worktree_id") == ["t1", "t3"]
    assert left(store, "projects", "project_id") == ["p", "q"] and store.read("memberships").count() == 2
    assert left(store, "edges", "edge") == [2, 3, 4] and left(store, "chunks", "view_id") == ["a", "d"]
    assert left(store, "facts", "fact_id") == ["f1", "f2", "f3", "f5"]  # a user's facts for a project or a group stay
    assert sorted(os.listdir(f"{home}/p")) == ["a"] and store.read("pending").count() == 0 and store.read("settings").count() == 1
    assert purge.stage(store, home, purge.actions(store.read("views"), store.read("worktrees"), branches), 0) is None


@pytest.mark.parametrize("stop", ["contents", "first folder", "second folder", "entries"])
def test_stopped_purge_is_taken_up(spark, tmp_path, monkeypatch, stop):
    """Whatever a purge is stopped at, readers see whole versions, the journal keeps it, and recover() brings what no stop brings."""
    store, home = made(spark, tmp_path)
    purge_id = purge.stage(store, home, purge.whole_projects(store.read("views"), spark.createDataFrame([("p",)], "project_id string")), 0)
    staged = store.generation()
    assert {r.view_id: (r.state, r.active) for r in store.read("views").collect()} == {"a": ("deleting", False), "b": ("deleting", False), "c": ("deleting", False), "d": ("ready", False)}

    class Stop(Exception):
        pass

    calls = {"update": 0, "delete": 0}

    def counted(name, least):
        whole = getattr(Store, name)

        def run(self, *args, **kw):
            calls[name] += 1
            if calls[name] == least:
                raise Stop
            return whole(self, *args, **kw)

        return run

    with monkeypatch.context() as m:
        name, least = {"contents": ("update", 1), "first folder": ("delete", 1), "second folder": ("delete", 2), "entries": ("update", 2)}[stop]
        m.setattr(Store, name, counted(name, least))
        with pytest.raises(Stop):
            purge.finish(store, home, purge_id, 0)
    assert store.read("pending").count() == 3 and store.generation() == staged + (stop != "contents")
    assert left(store, "views", "view_id") == ["a", "b", "c", "d"]
    found = spark.createDataFrame([("p",), ("q",), ("new",)], "project_id string")
    assert [r.project_id for r in purge.pending_projects(store.snapshot(), found).collect()] == ["p"]
    assert purge.recover(Store(spark, store.root), home, 0) == [purge_id]
    assert left(store, "views", "view_id") == ["d"] and left(store, "projects", "project_id") == ["q"] and left(store, "worktrees", "worktree_id") == ["t3"]
    assert left(store, "memberships", "project_id") == ["q"] and left(store, "edges", "edge") == [3, 4] and left(store, "chunks", "view_id") == ["d"]
    assert left(store, "facts", "fact_id") == ["f3", "f5"] and os.listdir(f"{home}/p") == [] and os.listdir(f"{home}/q") == ["d"]
    assert purge.recover(store, home, 0) == [] and not purge.finish(store, home, purge_id, 0)


def test_refusals_change_nothing(spark, tmp_path):
    """Leases, places outside of the root or the root itself, and views of other projects stop a purge before it begins; a lease taken later holds it up."""
    store, home = made(spark, tmp_path)
    whole = lambda: purge.whole_projects(store.read("views"), spark.createDataFrame([("p",)], "project_id string"))
    lease = lambda until: spark.createDataFrame([("b", until)], purge.LEASES)
    store.commit({"leases": lease(50)})
    with pytest.raises(purge.InUse):
        purge.stage(store, home, whole(), 10)
    for root in (f"{tmp_path}/elsewhere", f"{home}/p/a", f"{home}/p/a/deeper"):
        with pytest.raises(ValueError, match="outside"):
            purge.stage(store, root, whole(), 100)
    with pytest.raises(ValueError, match="isn't a view"):
        purge.stage(store, home, spark.createDataFrame([("branch", "d", "p", "d", "")], "kind string, id string, project_id string, view_id string, reason string"), 100)
    assert store.generation() == 2 and "pending" not in store.snapshot().tables
    purge_id = purge.stage(store, home, whole(), 100)
    store.update(lambda s: {"leases": s.read("leases").limit(0).unionByName(lease(500))})
    assert purge.recover(store, home, 200) == [] and store.read("pending").count() == 3 and os.path.exists(f"{home}/p/b/x")
    assert purge.recover(store, home, 501) == [purge_id] and left(store, "views", "view_id") == ["d"]


def test_project_without_views(spark, tmp_path):
    store, home = made(spark, tmp_path)
    store.update(lambda s: {"projects": s.read("projects").unionByName(spark.createDataFrame([("bare",)], "project_id string"))})
    purge.purge(store, home, purge.whole_projects(store.read("views"), spark.createDataFrame([("bare",)], "project_id string")), 0)
    assert left(store, "projects", "project_id") == ["p", "q"] and store.read("views").count() == 4 and store.read("chunks").count() == 12
