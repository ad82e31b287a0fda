"""JSON bundles of typed objects as tables of nodes and edges, and the sinks that keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import or_empty

STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S = T.StringType()
#: Every field that is read of an object; a bundle may lack any. log sources are kept as JSON text.
OBJECT = _struct(
    type=S, id=S, name=S, description=S, revoked=T.BooleanType(), x_mitre_deprecated=T.BooleanType(),
    external_references=T.ArrayType(_struct(source_name=S, external_id=S, url=S)),
    kill_chain_phases=T.ArrayType(_struct(phase_name=S)), x_mitre_platforms=STRINGS, x_mitre_is_subtechnique=T.BooleanType(),
    aliases=STRINGS, x_mitre_aliases=STRINGS, x_mitre_shortname=S, first_seen=S, last_seen=S,
    x_mitre_log_sources=T.ArrayType(T.MapType(S, S)), x_mitre_log_source_references=T.ArrayType(_struct(x_mitre_data_component_ref=S)),
    x_mitre_analytic_refs=STRINGS, source_ref=S, target_ref=S, relationship_type=S,
)
BUNDLE = _struct(objects=T.ArrayType(OBJECT))

#: Type of object for each type of node; those that a relationship may join are marked.
KINDS = [
    ("attack-pattern", "Technique", True),
    ("intrusion-set", "Actor", True),
    ("malware", "Malware", True),
    ("tool", "Tool", True),
    ("course-of-action", "Mitigation", True),
    ("x-mitre-tactic", "Tactic", False),
    ("campaign", "Campaign", True),
    ("x-mitre-data-component", "DataComponent", False),
    ("x-mitre-analytic", "Analytic", False),
    ("x-mitre-detection-strategy", "DetectionStrategy", True),
]
#: Columns of each parsed table, in order.
COMMON = ["id", "name", "description", "external_id", "url"]
TABLES = {
    "techniques": ("Technique", [*COMMON, "kill_chain_phases", "platforms", "is_subtechnique"]),
    "actors": ("Actor", [*COMMON, "aliases"]),
    "malware": ("Malware", [*COMMON, "platforms", "aliases"]),
    "tools": ("Tool", [*COMMON, "platforms", "aliases"]),
    "mitigations": ("Mitigation", COMMON),
    "tactics": ("Tactic", [*COMMON, "shortname"]),
    "campaigns": ("Campaign", [*COMMON, "first_seen", "last_seen"]),
    "data_components": ("DataComponent", [*COMMON, "log_sources"]),
    "analytics": ("Analytic", [*COMMON, "platforms", "data_component_refs"]),
    "detection_strategies": ("DetectionStrategy", ["id", "name", "external_id", "url", "analytic_refs"]),
}


def read_bundle(spark: SparkSession, path: str, malformed: str = "FAILFAST") -> DataFrame:
    """Objects of the bundle documents at a path, one row each; the schema is given, never inferred.

    A document that is no JSON, or has a field of another type, raises; with malformed as DROPMALFORMED it is left out.
    """
    return spark.read.schema(BUNDLE).json(path, multiLine=True, mode=malformed).selectExpr("inline(objects)")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parsed table stored as JSON lines; see read_array() for one JSON array."""
    return spark.read.schema(schema).json(path)


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parsed table stored as one JSON array a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> DataFrame:
    """Write each table under folder; (table, rows) of what was written."""
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{folder}/{name}")
        counts.append((name, df.sparkSession.read.schema(df.schema).format(form).load(f"{folder}/{name}").count()))
    return next(iter(tables.values())).sparkSession.createDataFrame(counts, "table string, rows long")


def active(objects: DataFrame) -> DataFrame:
    """Objects that are neither deprecated nor revoked; a missing mark counts as false."""
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    return objects.where(~off("x_mitre_deprecated") & ~off("revoked"))


def _first(refs: Column, test, value: str) -> Column:
    return F.try_element_at(F.filter(refs, test), F.lit(1)).getField(value)


def parse_nodes(objects: DataFrame) -> DataFrame:
    """One row for each active object that is a node, with the columns of all tables.

    external_id is that of the first reference which has one; url that of the first reference of source mitre-attack.
    Lists that are missing are empty, is_subtechnique false.
    """
    kind = F.create_map(*[F.lit(x) for t, n, _ in KINDS for x in (t, n)])
    nodes = active(objects).withColumn("node_type", F.try_element_at(kind, F.coalesce("type", F.lit("")))).where("node_type is not null")
    refs = F.col("external_references")
    is_type = lambda *t: F.col("node_type").isin(*t)
    given = lambda types, c: F.when(is_type(*types), c)
    refs_of = F.filter(F.transform("x_mitre_log_source_references", lambda r: r.x_mitre_data_component_ref), lambda r: r.isNotNull())
    return nodes.select(
        "id",
        "node_type",
        "name",
        F.when(~is_type("DetectionStrategy"), F.col("description")).alias("description"),
        _first(refs, lambda r: r.external_id.isNotNull(), "external_id").alias("external_id"),
        _first(refs, lambda r: r.source_name == "mitre-attack", "url").alias("url"),
        given(["Technique"], or_empty(F.transform("kill_chain_phases", lambda p: p.phase_name))).alias("kill_chain_phases"),
        given(["Technique", "Malware", "Tool", "Analytic"], or_empty(F.col("x_mitre_platforms"))).alias("platforms"),
        given(["Technique"], F.coalesce("x_mitre_is_subtechnique", F.lit(False))).alias("is_subtechnique"),
        F.when(is_type("Actor"), or_empty(F.col("aliases"))).when(is_type("Malware", "Tool"), or_empty(F.col("x_mitre_aliases"))).alias("aliases"),
        given(["Tactic"], F.col("x_mitre_shortname")).alias("shortname"),
        given(["Campaign"], F.col("first_seen")).alias("first_seen"),
        given(["Campaign"], F.col("last_seen")).alias("last_seen"),
        given(["DataComponent"], F.coalesce(F.to_json("x_mitre_log_sources"), F.lit("[]"))).alias("log_sources"),
        given(["Analytic"], or_empty(refs_of)).alias("data_component_refs"),
        given(["DetectionStrategy"], or_empty(F.col("x_mitre_analytic_refs"))).alias("analytic_refs"),
    )


def parse_relationships(objects: DataFrame) -> DataFrame:
    return active(objects).where("type = 'relationship'").select("source_ref", "target_ref", "relationship_type")


def tables(objects: DataFrame) -> dict[str, DataFrame]:
    """The ten tables of nodes and the table of relationships."""
    nodes = parse_nodes(objects)
    out = {name: nodes.where(F.col("node_type") == kind).select(*columns) for name, (kind, columns) in TABLES.items()}
    return out | {"relationships": parse_relationships(objects)}


# --- sinks ------------------------------------------------------------------------------------------------------------
def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """current with changes merged in: of a key's changes the last by order counts; it replaces each property it sets.

    Columns that only one side has are kept. A change sets all columns it has, null values too. A null key matches nothing,
    so that each change with one is a row of its own.
    """
    changes = changes.withColumn("__loose", F.greatest(*[F.col(c).isNull() for c in key], F.lit(False)))
    drop = [c for c in order if c not in current.columns]
    loose = changes.where("__loose").drop("__loose", *drop)
    last = F.expr(f"row_number() over (partition by {', '.join(key)} order by {', '.join(f'{c} desc' for c in order)})")
    changes = changes.where("not __loose").withColumn("__rn", last).where("__rn = 1").drop("__rn", "__loose", *drop)
    sets = [c for c in changes.columns if c not in key]
    new = changes.select(*key, F.struct(*[F.col(c) for c in sets], F.lit(1).alias("__")).alias("__new"))
    both = current.select(*key, F.struct(*[c for c in current.columns if c not in key], F.lit(1).alias("__")).alias("__old")).join(new, key, "full")
    columns = [*current.columns, *[c for c in sets if c not in current.columns]]

    def value(c: str) -> Column:
        old = F.col("__old").getField(c) if c in current.columns else F.lit(None)
        return F.when(F.col("__new").isNotNull(), F.col("__new").getField(c)).otherwise(old) if c in sets else old

    return both.select(*[F.col(c) if c in key else value(c).alias(c) for c in columns]).unionByName(loose, allowMissingColumns=True)


def broken_keys(nodes: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of keys that more than one row has."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(nodes: DataFrame, key: str = "id") -> DataFrame:
    """nodes, after a check that raises ValueError if a key repeats."""
    if bad := broken_keys(nodes, key).limit(5).collect():
        raise ValueError(f"{key} is not unique: {[r[0] for r in bad]}")
    return nodes


def resolve(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (src, rel, dst) of pairs(src, rel, dst[, src_type, dst_type]) whose ends exist with those types."""
    ids = nodes.select("id", "node_type")
    typed = "src_type" in pairs.columns
    a = ids.select(F.col("id").alias("src"), *([F.col("node_type").alias("src_type")] if typed else []))
    b = ids.select(F.col("id").alias("dst"), *([F.col("node_type").alias("dst_type")] if typed else []))
    on = lambda end: [end, f"{end}_type"] if typed else [end]
    return pairs.join(a, on("src"), "left_semi").join(b, on("dst"), "left_semi").select("src", "rel", "dst").distinct()


def candidate_edges(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """(src, rel, dst, src_type, dst_type) of all that the tables state, whether or not both ends exist.

    Relationships count only between the types that may be joined by one, told by the identifiers' prefixes.
    """
    kind = F.create_map(*[F.lit(x) for t, n, joined in KINDS if joined for x in (t, n)])
    type_of = lambda c: F.try_element_at(kind, F.split_part(F.coalesce(c, F.lit("")), F.lit("--"), F.lit(1)))
    rel = F.upper(F.replace(F.col("relationship_type"), F.lit("-"), F.lit("_")))
    stated = relationships.select(F.col("source_ref").alias("src"), rel.alias("rel"), F.col("target_ref").alias("dst"), type_of(F.col("source_ref")).alias("src_type"), type_of(F.col("target_ref")).alias("dst_type"))
    stated = stated.where("src_type is not null and dst_type is not null")

    def listed(column: str, rel: str, src: str, dst: str) -> DataFrame:
        return nodes.where(F.col("node_type") == src).select(F.col("id").alias("src"), F.lit(rel).alias("rel"), F.explode(column).alias("dst"), F.lit(src).alias("src_type"), F.lit(dst).alias("dst_type"))

    tactics = nodes.where("node_type = 'Tactic'").select(F.col("shortname").alias("phase"), F.col("id").alias("dst"))
    phases = listed("kill_chain_phases", "BELONGS_TO_TACTIC", "Technique", "Tactic").withColumnRenamed("dst", "phase").join(tactics, "phase")
    out = stated.unionByName(listed("analytic_refs", "HAS_ANALYTIC", "DetectionStrategy", "Analytic"))
    out = out.unionByName(listed("data_component_refs", "USES_DATA_COMPONENT", "Analytic", "DataComponent"))
    return out.unionByName(phases.drop("phase"))


def edges(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """Distinct edges (src, rel, dst) between nodes that exist."""
    return resolve(candidate_edges(nodes, relationships), nodes)


def edge_report(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """(rel, attempted, written): edges stated, and distinct ones with both ends."""
    stated = candidate_edges(nodes, relationships).groupBy("rel").agg(F.count("*").alias("attempted"))
    return stated.join(edges(nodes, relationships).groupBy("rel").agg(F.count("*").alias("written")), "rel", "left").na.fill(0, ["written"])


def embedding_text(name: Column, description: Column) -> Column:
    """What is embedded of a node: name and description, or the name alone."""
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.coalesce(name, F.lit("None")), F.lit(". "), description)).otherwise(name)
