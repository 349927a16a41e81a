"""Views, groups and federation: which rows a prompt may see, and merging what several views give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrion.operators.common import small, top


def inside(path: Column, root: Column) -> Column:
    """Whether a normal path is a root or lies below it."""
    p = F.regexp_replace(path, "/+", "/")
    return ((p == root) | F.startswith(p, F.concat(root, F.lit("/")))) & ~p.rlike(r"(^|/)\.\.(/|$)")


def active_view(paths: DataFrame, views: DataFrame) -> DataFrame:
    """(path, view_id): the view with the longest root above a path. Roots meet a path's own ancestors by equality."""
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root_path")
    hits = paths.select("path", up).join(small(views.select("view_id", "root_path")), "root_path")
    return top(hits, ["path"], [F.desc(F.length("root_path")), "view_id"], 1).select("path", "view_id")


def members(views: DataFrame, memberships: DataFrame, group: str, all_worktrees: bool = False) -> DataFrame:
    """The views of a group's projects; of each project its primary one (active, then by id) unless all are asked for."""
    v = views.join(memberships.where(F.col("group") == group).select("project_id").distinct(), "project_id", "left_semi")
    return v if all_worktrees else top(v, ["project_id"], [F.desc("active"), "view_id"], 1)


def select_views(views: DataFrame, memberships: DataFrame, **by: str | bool) -> DataFrame:
    """Scope by one of view, project, group or all; branch narrows. Two of them, or none, is an error."""
    main = [k for k in ("view", "project", "group", "all") if by.get(k)]
    if len(main) != 1:
        raise ValueError("choose one of view, project, group, all")
    kind = main[0]
    if kind == "group":
        v = members(views, memberships, by["group"], bool(by.get("worktrees")))
    else:
        v = views if kind == "all" else views.where(F.col(f"{kind}_id") == by[kind])
    return v.where(F.col("branch") == by["branch"]) if by.get("branch") else v


def readable(views: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Views that are active, ready and of the checkout's generation."""
    ok = checkouts.select("view_id", F.col("generation").alias("checkout_generation"))
    return views.where(F.col("active") & (F.col("state") == "ready")).join(ok, ["view_id", "checkout_generation"], "left_semi")


def reconciled(views: DataFrame, found: DataFrame) -> DataFrame:
    """(view_id, action): add, keep, remove (worktree is gone) or drop-branch, comparing views with found(view_id, branch)."""
    f = found.select("view_id", F.col("branch").alias("f_branch"), F.lit(True).alias("f"))
    j = views.select("view_id", "branch", F.lit(True).alias("v")).join(f, "view_id", "full_outer")
    return j.select("view_id", F.when(F.col("v").isNull(), "add").when(F.col("f").isNull(), "remove").when(~F.col("branch").eqNullSafe(F.col("f_branch")), "drop-branch").otherwise("keep").alias("action"))


def without_views(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the views that go."""
    return {k: t.join(gone.select("view_id"), "view_id", "left_anti") for k, t in tables.items()}


def visible_facts(facts: DataFrame, views: list[str], projects: list[str], group: str | None) -> DataFrame:
    """Facts whose scope is one of the views, projects or the group, and whose evidence lies in the views."""
    by = (F.col("scope") == "view") & F.col("scope_id").isin(*views) | (F.col("scope") == "project") & F.col("scope_id").isin(*projects)
    if group is not None:
        by = by | (F.col("scope") == "group") & (F.col("scope_id") == group)
    return facts.where(by & F.forall(F.coalesce("evidence", F.array().cast("array<struct<view_id:string>>")), lambda e: e["view_id"].isin(*views)))


def federated(hits: DataFrame, active: DataFrame, k: int = 25, boost: float = 1.1) -> DataFrame:
    """hits(prompt_id, view_id, id, score) of several views in one ranking: where a prompt has more than one view, those of its
    active view (prompt_id, active_view) gain. Scores are fused ones, comparable between views."""
    n = F.size(F.collect_set("view_id").over(Window.partitionBy("prompt_id")))
    h = hits.withColumn("_n", n).join(small(active), "prompt_id", "left")
    h = h.withColumn("score", F.when((F.col("_n") > 1) & (F.col("view_id") == F.col("active_view")), F.col("score") * boost).otherwise(F.col("score")))
    return top(h, ["prompt_id"], [F.desc("score"), "view_id", "id"], k, "rank").drop("_n", "active_view")


def resolved_imports(imports: DataFrame, manifests: DataFrame, exports: DataFrame) -> DataFrame:
    """(import_id, target_ref, status) of imports(import_id, view_id, specifier, name).

    manifests(view_id, dependency, target_package) says which package a view's dependency is; exports(package, subpath, name,
    ref) what packages give. One match resolves; none or several don't.
    """
    spec = F.split("specifier", "/")
    scoped = F.startswith("specifier", F.lit("@"))
    package = F.when(scoped, F.concat_ws("/", F.get(spec, F.lit(0)), F.get(spec, F.lit(1)))).otherwise(F.get(spec, F.lit(0)))
    rest = F.array_join(F.slice(spec, F.when(scoped, 3).otherwise(2), F.size(spec)), "/")
    i = imports.withColumn("dependency", package).withColumn("subpath", rest)
    j = i.join(manifests, ["view_id", "dependency"], "left").join(exports.select(F.col("package").alias("target_package"), "subpath", "name", "ref"), ["target_package", "subpath", "name"], "left")
    n = j.groupBy("import_id").agg(F.count("ref").alias("n"), F.min("ref").alias("ref"), F.max(F.col("target_package").isNotNull()).alias("known"))
    return n.select("import_id", F.when(F.col("n") == 1, F.col("ref")).alias("target_ref"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("known"), "missing").otherwise("unknown-dependency").alias("status"))


def bound(tables: dict[str, DataFrame], old: dict, view: dict) -> tuple[dict[str, DataFrame], dict]:
    """(tables, identity) of a store bound to a view: every row gets its view_id, and the identity says so.

    old, view: view_id, root_path and whatever else is known. A store that was bound elsewhere needs to be indexed again; one that is bound
    alike is left as it is.
    """
    if all(old.get(k) == v for k, v in view.items()):
        return tables, old
    moved = bool(old.get("view_id")) and old.get("root_path") != view["root_path"]
    owned = {name: t.withColumn("view_id", F.lit(view["view_id"])) for name, t in tables.items()}
    return owned if old.get("view_id") != view["view_id"] or moved else tables, {**old, **view, "needs_reindex": moved or old.get("needs_reindex", False)}


def registered(dims: dict[str, DataFrame], found: DataFrame, group: str | None = None) -> dict[str, DataFrame]:
    """dims(projects, worktrees, views, memberships) with what a discovery found: (project_id, name, worktree_id, root_path, branch, head).

    A worktree has one view a branch, named worktree@branch; that of its branch now is active, the others stay, inactive. Rows
    that change get a higher revision, others keep theirs. group: the projects join it.
    """
    views = found.select(F.concat_ws("@", "worktree_id", "branch").alias("view_id"), "worktree_id", "project_id", "branch", "head", F.lit(True).alias("active"))
    seen = found.select("worktree_id").distinct()
    idle = dims["views"].join(seen, "worktree_id", "left_semi").join(views, "view_id", "left_anti").withColumn("active", F.lit(False))
    out = {
        "projects": _revised(dims["projects"], found.groupBy("project_id").agg(F.min("name").alias("name")), ["project_id"]),
        "worktrees": _revised(dims["worktrees"], found.select("worktree_id", "project_id", "root_path"), ["worktree_id"]),
        "views": _revised(dims["views"], views.unionByName(idle.select(views.columns)), ["view_id"]),
        "memberships": dims["memberships"],
    }
    if group is not None:
        new = found.select(F.lit(group).alias("group_id"), "project_id").distinct()
        out["memberships"] = dims["memberships"].unionByName(new.join(dims["memberships"], ["group_id", "project_id"], "left_anti"))
    return out


def _revised(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old(key, ..., revision) with new rows in place: revision 1, or one more where any value differs."""
    rest = [c for c in new.columns if c not in key]
    j = new.join(old.select(*key, F.struct(*rest).alias("_o"), F.col("revision").alias("_r")), key, "left")
    revision = F.when(F.col("_r").isNull(), 1).when(F.col("_o").eqNullSafe(F.struct(*rest)), F.col("_r")).otherwise(F.col("_r") + 1)
    return old.join(new, key, "left_anti").unionByName(j.select(*new.columns, revision.cast("long").alias("revision")).select(old.columns))


def learned_imports(hits: DataFrame, imports: DataFrame, resolved: DataFrame, files: int = 3, attempts: int = 6) -> tuple[DataFrame, DataFrame]:
    """(links, suggestions) that the files of a prompt's best hits give.

    hits: prompt_id, id, view_id, source_file, score. imports: view_id, source_file, source (the file's own ref), specifier, mode, k (place in the file), local
    (whether it names a path or a mapped package). resolved: view_id, source, specifier, mode, target, target_view. Of each prompt, the first `files` script files by score are
    looked at, and `attempts` distinct imports in all. What resolves into another view is a link; what looks local and doesn't resolve, a suggestion.
    """
    best = hits.where(F.col("source_file").rlike(r"(?i)\.[jt]sx?$")).groupBy("prompt_id", "view_id", "source_file").agg(F.max(F.struct("score", F.lit(0))).alias("s"), F.min("id").alias("id"))
    first = top(best.withColumn("score", F.col("s.score")), ["prompt_id"], [F.desc("score"), "id"], files, "file")
    each = imports.groupBy("view_id", "source_file", "source", "specifier", "mode").agg(F.min("k").alias("k"), F.max("local").alias("local"))
    tried = top(first.select("prompt_id", "view_id", "source_file", "file").join(each, ["view_id", "source_file"]), ["prompt_id"], ["file", "k", "specifier", "mode"], attempts)
    got = tried.join(resolved, ["view_id", "source", "specifier", "mode"], "left")
    links = got.where(F.col("target").isNotNull() & (F.col("target_view") != F.col("view_id"))).select("prompt_id", "source", "target", F.lit("imports").alias("type"), "specifier")
    return links.distinct(), got.where(F.col("target").isNull() & F.col("local")).select("prompt_id", "source", "specifier", "mode").distinct()
