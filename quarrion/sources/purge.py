"""Removing views from a store and from disk, with a journal that survives a stop at any point.

A purge is staged in one commit: the journal (table pending) gets a row for each view, and the views are marked. What follows can be done
over and over: rows that the views own go, then folders, and last, in one commit, the views' entries and the journal's rows. A
purge that was broken off is taken up by recover().
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.operators.common import small
from quarrion.operators.scope import inside
from quarrion.sources.store import Snapshot, Store

PENDING = "purge_id string, kind string, id string, project_id string, view_id string, place string"
LEASES = "view_id string, until long"
#: Columns that say which view a row belongs to; a row goes with any of them.
OWNERS = ("view_id", "source_view_id", "target_view_id")
#: Tables of the registry, which lose their rows last.
REGISTRY = ("views", "worktrees", "projects", "memberships", "leases", "pending")


class InUse(RuntimeError):
    """A view is leased by a writer; nothing has been changed."""


def actions(views: DataFrame, worktrees: DataFrame, branches: DataFrame) -> DataFrame:
    """(kind, id, project_id, view_id, reason): what a cleanup would remove.

    worktree: all views of one that is gone (removed) and not locked. branch: a view that isn't active, whose branch isn't in
    branches(project_id, branch); projects without any known branch are left alone, as are views that go with their worktree. A view without a
    branch never goes by branch.
    """
    gone = worktrees.where(F.col("removed") & ~F.coalesce("locked", F.lit(False))).select("worktree_id")
    trees = views.join(gone, "worktree_id", "left_semi").select(F.lit("worktree").alias("kind"), F.col("worktree_id").alias("id"), "project_id", "view_id", F.lit("worktree is gone").alias("reason"))
    idle = views.where(~F.coalesce("active", F.lit(False)) & F.col("branch").isNotNull()).join(gone, "worktree_id", "left_anti")
    idle = idle.join(branches.select("project_id").distinct(), "project_id", "left_semi").join(branches, ["project_id", "branch"], "left_anti")
    return trees.unionByName(idle.select(F.lit("branch").alias("kind"), F.col("view_id").alias("id"), "project_id", "view_id", F.lit("branch is gone").alias("reason")))


def whole_projects(views: DataFrame, projects: DataFrame) -> DataFrame:
    """Actions that remove projects(project_id) with all their views; one without views has a row with view_id null."""
    chosen = projects.select("project_id").distinct().join(views.select("project_id", "view_id"), "project_id", "left")
    return chosen.select(F.lit("project").alias("kind"), F.col("project_id").alias("id"), "project_id", "view_id", F.lit("asked for").alias("reason"))


def pending_projects(snapshot: Snapshot, found: DataFrame) -> DataFrame:
    """Projects of found(project_id) that are being purged: they can't be registered until that is finished."""
    return found.select("project_id").distinct().join(snapshot.read("pending", PENDING), "project_id", "left_semi")


def stage(store: Store, root: str, chosen: DataFrame, as_of: int) -> str | None:
    """Write actions to the journal and mark their views, in one commit; the purge's id, or None if there are none.

    Every view is looked at before anything is changed: one that is unknown or of another project, or whose place isn't a folder below
    root, is an error; one with a lease beyond as_of (ms) is InUse. Views that are in the journal already aren't staged again.
    """
    purge_id = uuid.uuid4().hex
    chosen = chosen.select("kind", "id", "project_id", "view_id").distinct()

    def tables(s: Snapshot) -> dict[str, DataFrame]:
        views, pending = s.read("views"), s.read("pending", PENDING)
        new = chosen.join(pending.select("kind", "id", "project_id"), ["kind", "id", "project_id"], "left_anti")
        rows = new.join(views.select("view_id", "project_id", "place"), ["view_id", "project_id"], "left").withColumn("purge_id", F.lit(purge_id)).select(*pending.columns)
        lost = rows.where("view_id is not null and place is null").first()
        if lost:
            raise ValueError(f"{lost.view_id} isn't a view of {lost.project_id}")
        _allowed(s, rows, root, as_of)
        marked = F.col("_gone").isNotNull()
        views = views.join(rows.where("view_id is not null").select("view_id", F.lit(True).alias("_gone")).distinct(), "view_id", "left")
        views = views.withColumns({"state": F.when(marked, "deleting").otherwise(F.col("state")), "active": F.when(marked, False).otherwise(F.col("active"))}).drop("_gone")
        return {"pending": pending.unionByName(rows), "views": views.select(*s.read("views").columns)}

    if chosen.isEmpty():
        return None
    store.update(tables)
    return purge_id


def _allowed(s: Snapshot, rows: DataFrame, root: str, as_of: int) -> None:
    """Raise unless all places lie below root and no view is leased."""
    root = re.sub("/+", "/", root).rstrip("/")  # as inside() has places
    bad = rows.where(F.col("place").isNotNull() & ~(inside(F.col("place"), F.lit(root)) & (F.regexp_replace("place", "/+$", "") != root))).first()
    if bad:
        raise ValueError(f"{bad.place} is outside of {root}")
    held = s.read("leases", LEASES).where(F.col("until") > as_of).join(rows.select("view_id"), "view_id", "left_semi").first()
    if held:
        raise InUse(f"{held.view_id} is leased until {held.until}")


def owned_by(table: DataFrame, gone: DataFrame, projects: DataFrame) -> DataFrame:
    """table without the rows that go with the views gone(view_id) or projects(project_id).

    Rows go by an owner column, or by evidence (an array of structs with view_id). Facts that a user stated for a project or a group stay, whatever
    their evidence, until the project itself goes.
    """
    out = table
    for c in (c for c in OWNERS if c in table.columns):
        out = out.join(small(gone.select(F.col("view_id").alias(c))), c, "left_anti")
    if "scope" in table.columns and "scope_id" in table.columns:
        of_project = projects.select(F.lit("project").alias("scope"), F.col("project_id").alias("scope_id"))
        out = out.join(small(of_project), ["scope", "scope_id"], "left_anti")
    if "evidence" in table.columns:
        key = next((c for c in ("fact_id", "link_id", "id") if c in table.columns), None)
        if key is None:
            raise ValueError("a table with evidence needs fact_id, link_id or id")
        views = F.explode(F.array_distinct(F.transform("evidence", lambda e: e["view_id"])))
        hit = out.where(~F.coalesce(_stated(table), F.lit(False))).select(key, views.alias("view_id"))
        out = out.join(hit.join(small(gone), "view_id", "left_semi").select(key).distinct(), key, "left_anti")
    return out.select(*table.columns)


def _stated(table: DataFrame) -> Column:
    """Whether a user stated it for more than a view."""
    if not {"provenance", "scope"} <= set(table.columns):
        return F.lit(False)
    return (F.col("provenance") == "user") & F.col("scope").isin("project", "group")


def finish(store: Store, root: str, purge_id: str, as_of: int) -> bool:
    """Take a staged purge to its end; false if it isn't in the journal (any more). Each step may be repeated."""
    s = store.snapshot()
    mine = s.read("pending", PENDING).where(F.col("purge_id") == purge_id)
    if mine.isEmpty():
        return False
    _allowed(s, mine, root, as_of)

    def rows(now: Snapshot) -> tuple[DataFrame, DataFrame, DataFrame]:
        here = now.read("pending", PENDING).where(F.col("purge_id") == purge_id)
        return here, here.where("view_id is not null").select("view_id").distinct(), here.where("kind = 'project'").select("project_id").distinct()

    def contents(now: Snapshot) -> dict[str, DataFrame]:
        _, gone, projects = rows(now)
        owned = {n: now.read(n) for n in now.tables if n not in REGISTRY and not n.startswith("_")}
        return {n: owned_by(t, gone, projects) for n, t in owned.items() if {*OWNERS, "scope_id", "evidence"} & set(t.columns)}

    store.update(contents)
    for r in mine.where("place is not null").select("place").distinct().toLocalIterator():  # folders, one a registered view
        store.delete(r.place)

    def entries(now: Snapshot) -> dict[str, DataFrame]:
        here, gone, projects = rows(now)
        trees = here.where("kind = 'worktree'").select(F.col("id").alias("worktree_id")).distinct()
        out = {"pending": now.read("pending", PENDING).where(F.col("purge_id") != purge_id)}
        for name, keys in (("views", [gone]), ("leases", [gone]), ("worktrees", [trees, projects]), ("projects", [projects]), ("memberships", [projects])):
            if name in now.tables:
                t = now.read(name)
                for k in keys:
                    t = t.join(k, k.columns, "left_anti") if k.columns[0] in t.columns else t
                out[name] = t
        return out

    store.update(entries)
    return True


def purge(store: Store, root: str, chosen: DataFrame, as_of: int) -> str | None:
    """Stage and finish."""
    purge_id = stage(store, root, chosen, as_of)
    if purge_id:
        finish(store, root, purge_id, as_of)
    return purge_id


def recover(store: Store, root: str, as_of: int) -> list[str]:
    """Finish what the journal holds, to be called when a session begins; the ids that were finished. What is leased stays in the journal."""
    done = []
    for r in store.snapshot().read("pending", PENDING).select("purge_id").distinct().orderBy("purge_id").toLocalIterator():
        try:
            if finish(store, root, r.purge_id, as_of):
                done.append(r.purge_id)
        except InUse:
            continue
    return done
