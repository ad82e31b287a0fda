"""Neighbourhoods of nodes, declared as a table of paths.

Paths are followed each by itself, so branches never multiply; where a path is not there, the list is empty. All paths of
all types of nodes take their steps together: one join a step, and one aggregate in the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import empty_strings
from graphloom.sources.scratch import materialise


@dataclass(frozen=True)
class Path:
    """From a start type over hops (relation, out or in, type) to a value, under a field's name: that of the last node, or
    of the one that so many hops lead to; all hops have to be there even then."""

    start: str
    field: str
    hops: tuple[tuple[str, str, str], ...]
    value: str = "name"
    after: int | None = None


def _paths() -> list[Path]:
    """All paths of the ten types of nodes."""
    uses = lambda way, kind: (("USES", way, kind),)
    tactic = ("BELONGS_TO_TACTIC", "out", "Tactic")
    technique = ("USES", "out", "Technique")
    analytic, component = ("HAS_ANALYTIC", "out", "Analytic"), ("USES_DATA_COMPONENT", "out", "DataComponent")
    detects = ("DETECTS", "in", "DetectionStrategy")
    out = [
        Path("Technique", "tactics", (tactic,)),
        Path("Technique", "mitigations", (("MITIGATES", "in", "Mitigation"),)),
        Path("Technique", "actors", uses("in", "Actor")),
        Path("Technique", "malware", uses("in", "Malware")),
        Path("Technique", "tools", uses("in", "Tool")),
        Path("Technique", "campaigns", uses("in", "Campaign")),
        Path("Technique", "detections", (detects,)),
        # here an analytic without a data component does not count, as both hops are one path
        Path("Technique", "analytics", (detects, analytic, component), "description", 2),
        Path("Technique", "log_source_names", (detects, analytic, component)),
        Path("Technique", "parent_techniques", (("SUBTECHNIQUE_OF", "out", "Technique"),)),
        Path("Technique", "subtechniques", (("SUBTECHNIQUE_OF", "in", "Technique"),)),
        Path("Actor", "techniques", (technique,)),
        Path("Actor", "malware", uses("out", "Malware")),
        Path("Actor", "tools", uses("out", "Tool")),
        Path("Actor", "campaigns", (("ATTRIBUTED_TO", "in", "Campaign"),)),
        Path("Actor", "tactics", (technique, tactic)),
    ]
    for kind in ("Malware", "Tool"):
        out += [
            Path(kind, "techniques", (technique,)),
            Path(kind, "actors", uses("in", "Actor")),
            Path(kind, "campaigns", uses("in", "Campaign")),
            Path(kind, "tactics", (technique, tactic)),
            Path(kind, "mitigations", (technique, ("MITIGATES", "in", "Mitigation"))),
        ]
    mitigated, within = ("MITIGATES", "out", "Technique"), ("BELONGS_TO_TACTIC", "in", "Technique")
    detected, held = ("DETECTS", "out", "Technique"), ("HAS_ANALYTIC", "in", "DetectionStrategy")
    used = ("USES_DATA_COMPONENT", "in", "Analytic")
    out += [
        Path("Mitigation", "techniques", (mitigated,)),
        Path("Mitigation", "tactics", (mitigated, tactic)),
        Path("Mitigation", "actors", (mitigated, ("USES", "in", "Actor"))),
        Path("Tactic", "techniques", (within,)),
        Path("Tactic", "actors", (within, ("USES", "in", "Actor"))),
        Path("Tactic", "mitigations", (within, ("MITIGATES", "in", "Mitigation"))),
        Path("Campaign", "techniques", (technique,)),
        Path("Campaign", "malware", uses("out", "Malware")),
        Path("Campaign", "tools", uses("out", "Tool")),
        Path("Campaign", "actors", (("ATTRIBUTED_TO", "out", "Actor"),)),
        Path("Campaign", "tactics", (technique, tactic)),
        Path("DetectionStrategy", "techniques", (detected,)),
        Path("DetectionStrategy", "analytics", (analytic,), "description"),
        Path("DetectionStrategy", "log_source_names", (analytic, component)),
        Path("DetectionStrategy", "tactics", (detected, tactic)),
        Path("Analytic", "log_source_names", (component,)),
        Path("Analytic", "detection_strategies", (held,)),
        Path("Analytic", "techniques", (held, detected)),
        Path("DataComponent", "analytics", (used,)),
        Path("DataComponent", "detection_strategies", (used, held)),
        Path("DataComponent", "techniques", (used, held, detected)),
    ]
    return out


PATHS = _paths()
#: Scalar columns that each type of node shows; all show name and external_id, and all but DetectionStrategy description.
SHOWN = {"Technique": ["platforms", "is_subtechnique"], "Actor": ["aliases"], "Malware": ["platforms", "aliases"], "Tool": ["platforms", "aliases"], "Mitigation": [], "Tactic": ["shortname"], "Campaign": ["first_seen", "last_seen"], "DetectionStrategy": [], "Analytic": ["platforms"], "DataComponent": ["log_sources"]}


def steps(nodes: DataFrame, edges: DataFrame, hops: set[tuple[str, str, str]]) -> DataFrame:
    """(at, rel, way, kind, next) of the edges that hops may take, with the values of the next node: relations and ways
    that none takes are not read."""
    values = [c for c in ("name", "description") if c in nodes.columns]
    ends = nodes.where(F.col("node_type").isin(sorted({k for *_, k in hops}))).select(F.col("id").alias("next"), F.col("node_type").alias("kind"), *values)
    sides = []
    for way, a, b in (("out", "src", "dst"), ("in", "dst", "src")):
        if rels := sorted({r for r, w, _ in hops if w == way}):
            sides.append(edges.where(F.col("rel").isin(rels)).select(F.col(a).alias("at"), "rel", F.lit(way).alias("way"), F.col(b).alias("next")))
    return (sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])).join(ends, "next")


#: Edges of one relation and way that make a node a hub, at least.
HUB = 10_000
#: Rows of a frontier on hubs that are broadcast at most.
FRONTIER = 200_000


def degrees(edges: DataFrame, least: int = HUB) -> DataFrame:
    """(at, rel, way) of the hubs: written once beside a graph and given to follow()."""
    ends = [edges.select(F.col(end).alias("at"), "rel", F.lit(way).alias("way")) for way, end in (("out", "src"), ("in", "dst"))]
    return ends[0].unionByName(ends[1]).groupBy("at", "rel", "way").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("at", "rel", "way")


def _step(now: DataFrame, edge: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """now joined with edge. The edges of a hub stay where they are, if the frontier on hubs is small enough to come to them."""
    on = ["at", "rel", "way", "kind"]
    if hubs is not None:
        now = materialise(now, "frontier")
        crowded = now.join(hubs, ["at", "rel", "way"], "left_semi")
        n = crowded.limit(FRONTIER + 1).count()
        if 0 < n <= FRONTIER:
            rest = now.join(hubs, ["at", "rel", "way"], "left_anti").join(edge, on)
            return rest.unionByName(edge.join(F.broadcast(crowded), on).select(*rest.columns))
    return now.join(edge, on)


def follow(starts: DataFrame, nodes: DataFrame, edges: DataFrame, paths: list[Path], hubs: DataFrame | None = None) -> DataFrame:
    """(start, field, value) of all that paths lead to from starts(id, node_type).

    All paths take a step together: one join for each step of the longest path, whatever the number of paths. A node that
    several ways lead to is in the next frontier once for each start, path and value. Nodes and edges should be written
    tables, edges in folders by relation; hubs is what degrees() tells of them.
    """
    spark = starts.sparkSession
    rows = [(i, p.start, p.field, len(p.hops), p.value, (p.after or len(p.hops)) - 1) for i, p in enumerate(paths)]
    known = spark.createDataFrame(rows, "path int, node_type string, field string, length int, column string, value_hop int")
    at = starts.select(F.col("id").alias("start"), "node_type").join(F.broadcast(known.select("path", "node_type")), "node_type")  # known: a row for each path
    at = at.select("start", "path", F.col("start").alias("at"), F.lit(None).cast("string").alias("value"))
    out = None
    for i in range(max(len(p.hops) for p in paths)):
        edge = steps(nodes, edges, {p.hops[i] for p in paths if len(p.hops) > i})
        hops = [(n, *p.hops[i]) for n, p in enumerate(paths) if len(p.hops) > i]
        hop = spark.createDataFrame(hops, "path int, rel string, way string, kind string").join(known, "path")
        seen = F.when(F.col("column") == "id", F.col("next"))
        for c in ("name", "description"):
            if c in edge.columns:
                seen = seen.when(F.col("column") == c, F.col(c))
        now = _step(at.join(F.broadcast(hop.select("path", "rel", "way", "kind", "column", "length", "value_hop")), "path"), edge, hubs)
        value = F.when(F.col("value_hop") == i, seen).otherwise(F.col("value"))
        at = now.select("start", "path", "length", F.col("next").alias("at"), value.alias("value"))
        done = at.where(F.col("length") == i + 1).select("start", "path", "value")
        out = done if out is None else out.unionByName(done)
        at = at.where(F.col("length") > i + 1).select("start", "path", "at", "value").distinct()
    return out.join(F.broadcast(known.select("path", "field")), "path").select("start", "field", "value")


def neighbourhoods(starts: DataFrame, nodes: DataFrame, edges: DataFrame, paths: list[Path] | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(id, and a sorted list of distinct values for each field) of starts(id, node_type); null values are left out."""
    paths = PATHS if paths is None else paths
    fields = sorted({p.field for p in paths})
    lists = follow(starts, nodes, edges, paths, hubs).groupBy("start", "field").agg(F.sort_array(F.collect_set("value")).alias("values"))
    # a field of a start is one row by now
    lists = lists.groupBy("start").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("lists"))
    joined = starts.select("id").distinct().join(lists, F.col("id") == F.col("start"), "left")
    return joined.select("id", *[F.coalesce(F.try_element_at("lists", F.lit(f)), empty_strings()).alias(f) for f in fields])


def traverse(hits: DataFrame, nodes: DataFrame, edges: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """hits(query_id, pos, id, node_type[, external_id, score, source_score, rrf_score]) with what surrounds each node.

    node_id is the node's own identifier, external_id the hit's or else the node's. Hits whose node does not exist, or is
    of another type, are dropped; a type without paths shows name and description alone. parent_technique is the first
    parent by name. Lists are sorted. Order stays that of pos.
    """
    types = [*SHOWN]
    hits = materialise(hits, "hits")
    known = hits.select("id", "node_type").distinct()
    found = known.join(nodes, ["id", "node_type"])
    about = neighbourhoods(known.where(F.col("node_type").isin(types)), nodes, edges, hubs=hubs)
    shown = lambda c: F.when(F.col("node_type").isin([t for t, cols in SHOWN.items() if c in cols]), F.col(c)).alias(c)
    scalars = ["platforms", "is_subtechnique", "aliases", "shortname", "first_seen", "last_seen", "log_sources"]
    rows = found.select("id", "node_type", "name", F.when(F.col("node_type") != "DetectionStrategy", F.col("description")).alias("description"), F.col("external_id").alias("__external"), *[shown(c) for c in scalars if c in nodes.columns])
    rows = rows.join(about, "id", "left").withColumn("parent_technique", F.try_element_at("parent_techniques", F.lit(1))).drop("parent_techniques")
    extra = [c for c in ("score", "source_score", "rrf_score") if c in hits.columns]
    external = F.coalesce(F.col("__hit_external"), F.col("__external")) if "external_id" in hits.columns else F.col("__external")
    mine = hits.select("query_id", "pos", "id", "node_type", *([F.col("external_id").alias("__hit_external")] if "external_id" in hits.columns else []), *extra)
    out = mine.join(rows, ["id", "node_type"])
    return out.withColumn("external_id", external).drop("__external", "__hit_external").withColumnRenamed("id", "node_id")
