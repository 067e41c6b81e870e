"""Parent links to full hierarchies by tree contraction.

Each round contracts the forest of still unresolved links twice.  *Compress* takes out nodes with
exactly one child whose hash is smaller than that of both neighbours, so no two adjacent nodes go in
one round, and hands the link to the child.  *Rake* takes out all leaves.  Every removal is recorded
with the node it hung on at that time.  Running the records backwards gives each node its top, depth,
size and path, since the node a record refers to was always removed later.  Nodes without parent
never leave, and neither does the last node of a cycle, whose link ends at itself: what is left over
is exactly the tops and one core per cycle.

A round costs one aggregation and two equi-joins over the links that are left; they shrink by a
constant factor, so all rounds together move a constant multiple of the input.  A hub with very many
children is aggregated map-side; once few links are left, one task does the last rounds.  On the way back a hub is one build row that adaptive skew splitting
copies to the pieces of its children.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import SharedTables


def uuid_key(column: str | Column) -> Column:
    """Canonical spelling of a UUID in any case, with braces, blanks, urn prefix or without dashes.

    Blank is null; text that is no UUID stays as it is, trimmed and in lower case.
    """
    text = F.lower(F.trim(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"\s+", " ")))
    digits = F.regexp_replace(text, r"^urn:uuid:|[{}()\s-]", "")
    dashed = F.concat_ws("-", *(F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), dashed).when(text != "", text)


def distinct_nodes(rows: DataFrame, node: str, parent: str, root: str | None = None, newest: str | None = None) -> DataFrame:
    """One row per node: node, parent, root.  Of several rows of a node the newest counts.

    Ids are compared as UUIDs whatever their spelling; rows without an id are left out.
    """
    picked = rows.select(
        uuid_key(node).alias("node"),
        F.struct(
            (F.col(newest) if newest else F.lit(0)).alias("at"),
            uuid_key(parent).alias("parent"),
            (uuid_key(root) if root else F.lit(None).cast("string")).alias("root"),
        ).alias("row"),
    ).where("node is not null")
    return picked.groupBy("node").agg(F.max("row").alias("row")).select("node", "row.parent", "row.root")


def _smaller(a: Column, b: Column) -> Column:
    """Fixed random order of ids; with it the rounds of contraction stay logarithmic in the input."""
    return F.struct(F.xxhash64(a), a) < F.struct(F.xxhash64(b), b)


def _round(live: DataFrame, paths: bool) -> DataFrame:
    """One compress and rake over the links in ``live``.

    Result rows have ``state`` live, raked or compressed.  Raked rows stay one round longer in the
    next aggregation, where their weight reaches the node they hung on.
    """
    is_live = F.col("state") == "live"
    below = live.groupBy(F.col("parent").alias("of")).agg(
        F.sum(F.when(is_live, 1)).alias("children"),
        F.min(F.when(is_live, F.col("node"))).alias("only"),
        F.sum(F.when(is_live, F.col("on_link"))).alias("on_child_link"),
        F.sum(F.when(~is_live, F.col("weight") + F.col("on_link"))).alias("raked_weight"),
    )
    seen = (
        live.where(is_live)
        .join(below, F.col("node") == F.col("of"), "left")
        .withColumn("weight", F.col("weight") + F.coalesce("raked_weight", F.lit(0)))
        .drop("of", "raked_weight")
    )
    node, parent, only = F.col("node"), F.col("parent"), F.col("only")
    goes = (F.col("children") == 1) & (node != parent) & (F.col("under_top") | _smaller(node, parent)) & _smaller(node, only)
    seen = seen.withColumn("goes", F.coalesce(goes, F.lit(False)))
    path = [F.concat("via", F.array("node")).alias("add_via")] if paths else []
    handed = seen.where("goes").select(
        F.col("only").alias("to"),
        F.col("parent").alias("new_parent"),
        F.col("steps").alias("add_steps"),
        F.col("smallest").alias("add_smallest"),
        (F.col("weight") + F.col("on_link")).alias("add_on_link"),
        F.col("under_top").alias("new_under_top"),
        *path,
    )
    merged = seen.join(handed, F.col("node") == F.col("to"), "left")
    changed = {
        "parent": F.coalesce("new_parent", "parent"),
        "steps": F.col("steps") + F.coalesce("add_steps", F.lit(0)),
        "smallest": F.least("smallest", "add_smallest"),
        "on_link": F.col("on_link") + F.coalesce("add_on_link", F.lit(0)),
        "under_top": F.coalesce("new_under_top", "under_top"),
        "state": F.when(F.col("goes"), "compressed").when(F.col("children").isNull(), "raked").otherwise("live"),
    }
    if paths:
        changed["via"] = F.when(F.col("add_via").isNotNull(), F.concat("add_via", "via")).otherwise(F.col("via"))
    return merged.withColumns(changed).select(*LINK, *(["via"] if paths else []), "only", "on_child_link")


#: Links that are contracted inside one task once no more are left, which spares rounds of tiny jobs.
LAST_LINKS = 4_000
LINK = ["node", "parent", "steps", "smallest", "weight", "on_link", "under_top", "state"]


def hierarchy(nodes: DataFrame, paths: bool = False) -> DataFrame:
    """Top, depth and kind of every node of a node/parent table (see ``distinct_nodes``).

    Columns: node, parent, root, top, depth (links up to the top), top_kind (``root``: no parent;
    ``missing``: its parent is no node; ``cycle``: the walk never ends, depth is null and top is the
    smallest id on the cycle), on_cycle, descendants (null with a cycle) and, with ``paths``, path:
    ids from the top to the node, null with a cycle.  An empty table gives no rows.
    """
    store = SharedTables(nodes.sparkSession)
    nodes = store.put("nodes", nodes)
    ids = nodes.select(F.col("node").alias("found"))
    known = nodes.join(ids, nodes.parent == F.col("found"), "left")
    kind = F.when(F.col("parent").isNull(), "root").when(F.col("found").isNull(), "missing").otherwise("link")
    known = store.put("known", known.select("node", "parent", "root", kind.alias("kind")))
    tops = known.where("kind <> 'link'").select("node", F.col("kind").alias("top_kind"))
    links = known.where("kind = 'link'")
    top_ids = tops.select(F.col("node").alias("top_id"))
    live = links.join(top_ids, links.parent == F.col("top_id"), "left").select(
        "node",
        "parent",
        F.lit(1).cast("long").alias("steps"),
        F.col("node").alias("smallest"),
        F.lit(1).cast("long").alias("weight"),
        F.lit(0).cast("long").alias("on_link"),
        F.col("top_id").isNotNull().alias("under_top"),
        F.lit("live").alias("state"),
        *([F.array().cast("array<string>").alias("via")] if paths else []),
        F.lit(None).cast("string").alias("only"),
        F.lit(None).cast("long").alias("on_child_link"),
    )
    live = store.put("round-0", live)
    schema, rounds, tail = live.schema, 0, None
    while left := live.where("state = 'live' and node <> parent").limit(LAST_LINKS + 1).count():
        if left <= LAST_LINKS:
            tail = store.put("last", _last_rounds(_last_links(live), schema, paths))
            break
        rounds += 1
        live = store.put(f"round-{rounds}", _round(live.where("state <> 'compressed'").drop("only", "on_child_link"), paths))
    return _expand(store, known, tops, rounds, schema, tail, paths)


def _last_links(live: DataFrame) -> DataFrame:
    """The links still contracted, with the weight raked off them in the last round, and the cores they hang on.

    Callers see to it that at most ``LAST_LINKS`` links don't end at themselves, so rows are at most twice as many.  Raked rows
    (the leaves of a hub) and cores have no such bound: raked rows are summed by parent, and other cores are left out.
    """
    links = live.where("state = 'live' and node <> parent")
    heads = F.broadcast(links.select(F.col("node").alias("head")).distinct())
    raked = live.where("state = 'raked'").join(heads, F.col("parent") == F.col("head"), "left_semi")
    raked = raked.groupBy(F.col("parent").alias("of")).agg(F.sum(F.col("weight") + F.col("on_link")).alias("raked_weight"))
    weighed = links.join(F.broadcast(raked), F.col("node") == F.col("of"), "left").withColumn("weight", F.col("weight") + F.coalesce("raked_weight", F.lit(0)))
    parents = F.broadcast(links.select(F.col("parent").alias("above")).distinct())
    cores = live.where("state = 'live' and node = parent").join(parents, F.col("node") == F.col("above"), "left_semi")
    return weighed.select(*live.columns).unionByName(cores.select(*live.columns))


def _last_rounds(live: DataFrame, schema: StructType, paths: bool) -> DataFrame:
    """The same rounds for the last few links, inside one task, and their records run backwards.

    Rows as of ``_round`` and, resolved, ``ref`` (a top or a core), ``ref_steps`` to it, ``ref_size``,
    ``ref_on_cycle`` and ``ref_via``.  ``live`` is as of ``_last_links``; the cores in it aren't given back.
    """
    more = "ref string, ref_steps long, ref_size long, ref_on_cycle boolean, ref_via array<string>"
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", " + more
    columns = [f.name for f in schema.fields]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        links = {r["node"]: r for r in rows.to_dict("records")}
        given = {node for node, link in links.items() if node == link["parent"]}
        for link in links.values():
            link["via"] = list(link["via"]) if paths else []
        order = {node: at for at, node in enumerate(sorted(links, key=lambda n: (zlib.crc32(n.encode()), n)))}
        records: list[dict] = []
        alive = dict(links)
        while any(node != link["parent"] for node, link in alive.items()):
            children: dict[str, list[str]] = {}
            for node, link in alive.items():
                children.setdefault(link["parent"], []).append(node)
            goes = []
            for node, link in alive.items():
                below = children.get(node, ())
                if len(below) == 1 and node != link["parent"] and order[node] < order[below[0]] and (link["under_top"] or order[node] < order[link["parent"]]):
                    goes.append((node, below[0]))
            for node, child in goes:
                link, heir = alive.pop(node), alive[child]
                records.append(link | {"state": "compressed", "only": child, "on_child_link": heir["on_link"]})
                heir.update(parent=link["parent"], steps=heir["steps"] + link["steps"], smallest=min(heir["smallest"], link["smallest"]), under_top=link["under_top"])
                heir["on_link"] += link["weight"] + link["on_link"]
                heir["via"] = link["via"] + [node] + heir["via"]
            for node in [n for n in alive if n not in children]:
                link = alive.pop(node)
                records.append(link | {"state": "raked"})
                if link["parent"] in alive:
                    alive[link["parent"]]["weight"] += link["weight"] + link["on_link"]
        found = {node: (node, 0, None, True, []) for node in alive}
        resolved = [link | {"ref": None, "ref_steps": None, "ref_size": None, "ref_on_cycle": None, "ref_via": None} for node, link in alive.items() if node not in given]
        for record in reversed(records):
            ref, steps, _, _, via = found.get(record["parent"], (record["parent"], 0, None, False, []))
            inner = [record["parent"]] if record["parent"] in found and record["parent"] not in alive else []
            if record["state"] == "raked":
                size, on_cycle = record["weight"], False
            else:
                _, _, below, on_cycle, _ = found[record["only"]]
                size = None if below is None else record["weight"] + record["on_child_link"] + below
            path = via + inner + record["via"] if paths else []
            found[record["node"]] = (ref, steps + record["steps"], size, on_cycle, path)
            resolved.append(record | {"ref": ref, "ref_steps": steps + record["steps"], "ref_size": size, "ref_on_cycle": on_cycle, "ref_via": path})
        frame = pd.DataFrame(resolved, columns=[*columns, "ref", "ref_steps", "ref_size", "ref_on_cycle", "ref_via"])
        return frame.astype({c: "Int64" for c in ("steps", "weight", "on_link", "on_child_link", "ref_steps", "ref_size")})

    return live.groupBy().applyInPandas(run, out)


def _expand(store: SharedTables, known: DataFrame, tops: DataFrame, rounds: int, schema: StructType, tail: DataFrame | None, paths: bool) -> DataFrame:
    """Run the records backwards: tops and cores first, then the nodes removed last, and so on."""
    via = ["via"] if paths else []
    every = store.get(schema, *(f"round-{i}" for i in range(rounds + 1)))
    if tail is not None:
        every = every.unionByName(tail.select(*schema.names))
    raked_on_top = every.where("state = 'raked' and under_top").groupBy(F.col("parent").alias("t")).agg(F.sum(F.col("weight") + F.col("on_link")).alias("w"))
    start = tops.join(raked_on_top, tops.node == F.col("t"), "left").select(
        "node",
        F.col("node").alias("top"),
        F.lit(0).cast("long").alias("depth"),
        "top_kind",
        F.lit(False).alias("on_cycle"),
        (1 + F.coalesce("w", F.lit(0))).alias("size"),
        *([F.array("node").alias("path")] if paths else []),
    )
    last = store.get(schema, f"round-{rounds}").where("state = 'live' and node = parent")
    if tail is not None:
        last = last.unionByName(tail.where("state = 'live'").select(*schema.names))
    cores = last.select(
        "node",
        F.col("smallest").alias("top"),
        F.lit(None).cast("long").alias("depth"),
        F.lit("cycle").alias("top_kind"),
        F.lit(True).alias("on_cycle"),
        F.lit(None).cast("long").alias("size"),
        *([F.lit(None).cast("array<string>").alias("path")] if paths else []),
    )
    base = store.put("resolved-0", start.unionByName(cores))
    resolved, done_names = base.schema, ["resolved-0"]
    if tail is not None:
        ends = base.select(F.col("node").alias("end"), "top", F.col("depth").alias("end_depth"), "top_kind", *([F.col("path").alias("end_path")] if paths else []))
        near = tail.where("ref is not null").join(ends, F.col("ref") == F.col("end"))
        near = near.select(
            "node",
            "top",
            (F.col("end_depth") + F.col("ref_steps")).alias("depth"),
            "top_kind",
            F.col("ref_on_cycle").alias("on_cycle"),
            F.when(F.col("top_kind") != "cycle", F.col("ref_size")).alias("size"),
            *([F.when(F.col("top_kind") != "cycle", F.concat("end_path", "ref_via", F.array("node"))).alias("path")] if paths else []),
        )
        store.put("resolved-last", near)
        done_names.append("resolved-last")
    for step in range(1, rounds + 1):
        done = store.get(schema, f"round-{rounds + 1 - step}")
        so_far = store.get(resolved, *done_names)
        up = so_far.select(F.col("node").alias("ref"), "top", F.col("depth").alias("ref_depth"), "top_kind", *([F.col("path").alias("ref_path")] if paths else []))
        hung = done.where("state <> 'live'").join(up, F.col("parent") == F.col("ref"))
        own = hung.select(
            "node",
            "top",
            (F.col("ref_depth") + F.col("steps")).alias("depth"),
            "top_kind",
            "state",
            "only",
            "weight",
            "on_child_link",
            *([F.when(F.col("top_kind") != "cycle", F.concat("ref_path", *via, F.array("node"))).alias("path")] if paths else []),
        )
        # A compressed node learns its size, and whether it lies on a cycle, from the child that took its link.
        raked = done.where("state = 'raked'").select(F.col("node").alias("owner"), F.lit(False).alias("owner_on_cycle"), F.col("weight").alias("owner_size"))
        owners = so_far.select(F.col("node").alias("owner"), F.col("on_cycle").alias("owner_on_cycle"), F.col("size").alias("owner_size")).unionByName(raked)
        both = own.join(owners, F.when(F.col("state") == "compressed", F.col("only")) == F.col("owner"), "left")
        size = F.when(F.col("state") == "raked", F.col("weight")).otherwise(F.col("weight") + F.col("on_child_link") + F.col("owner_size"))
        resolved_here = both.select(
            "node",
            "top",
            "depth",
            "top_kind",
            F.coalesce("owner_on_cycle", F.lit(False)).alias("on_cycle"),
            F.when(F.col("top_kind") != "cycle", size).alias("size"),
            *(["path"] if paths else []),
        )
        store.put(f"resolved-{step}", resolved_here)
        done_names.append(f"resolved-{step}")
    everything = store.get(resolved, *done_names).withColumnRenamed("node", "id")
    joined = known.join(everything, known.node == F.col("id"), "inner")
    return joined.select(
        "node", "parent", "root", "top", "depth", "top_kind", "on_cycle", (F.col("size") - 1).alias("descendants"), *(["path"] if paths else [])
    )


def execution_nodes(executions: DataFrame) -> DataFrame:
    """Nodes of an executions table; redelivered rows count once, the newest ``updated_at`` wins."""
    return distinct_nodes(executions, "execution_id", "parent_execution_id", "root_execution_id", "updated_at")


def hierarchy_findings(executions: DataFrame) -> DataFrame:
    """execution_id, finding, top_id for cycles, lost parents and false roots.

    cycle and into_cycle name the smallest id on the cycle, missing_parent itself, detached the
    node with the lost parent, wrong_root the true top.  Sound executions give no row.
    """
    every = hierarchy(execution_nodes(executions))
    top_is_self = F.col("top") == F.col("node")
    finding = (
        F.when(F.col("on_cycle"), "cycle")
        .when(F.col("top_kind") == "cycle", "into_cycle")
        .when((F.col("top_kind") == "missing") & top_is_self, "missing_parent")
        .when(F.col("top_kind") == "missing", "detached")
        .when(~F.coalesce(F.col("root") == F.col("top"), F.lit(False)), "wrong_root")
    )
    return every.select(F.col("node").alias("execution_id"), finding.alias("finding"), F.col("top").alias("top_id")).where("finding is not null")


def hierarchy_paths(executions: DataFrame) -> DataFrame:
    """execution_id, top_id, depth, path (ids joined by ``/``) and descendants of each execution."""
    every = hierarchy(execution_nodes(executions), paths=True)
    return every.select(F.col("node").alias("execution_id"), F.col("top").alias("top_id"), "depth", F.array_join("path", "/").alias("path"), "descendants")


def descendant_links(executions: DataFrame) -> DataFrame:
    """One row per node and descendant: execution_id, descendant_id, distance.  Cycles give none."""
    every = hierarchy(execution_nodes(executions), paths=True)
    above = every.where("depth > 0").select(F.col("node").alias("descendant_id"), "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "execution_id"))
    return above.select("execution_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
