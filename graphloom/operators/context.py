"""From ranked nodes to an answer: which nodes count, comparisons, and the context that a generator is given."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions import values as V
from graphloom.operators.ports import Generator
from graphloom.operators.search import top


def _list(df: DataFrame, c: str) -> Column:
    """A column as a list without nulls and empty texts; missing columns are empty."""
    if c not in df.columns:
        return X.empty_strings()
    items = X.or_empty(F.col(c)) if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("string"))
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def _lowered(items: Column) -> Column:
    return F.transform(items, F.lower)


def is_mentioned_actor() -> Column:
    return F.coalesce((F.col("node_type") == "Actor") & X.mentions(F.col("name"), F.col("query")), F.lit(False))


def platform_actor_filter(rows: DataFrame) -> DataFrame:
    """rows(query_id, query, nodes' columns); where a query names platforms and an actor among its rows, only actors and
    rows that list both that actor and such a platform stay."""
    w = Window.partitionBy("query_id")
    rows = rows.withColumn("__actors", F.collect_set(F.when(is_mentioned_actor(), F.lower("name"))).over(w)).withColumn("__platforms", X.query_platforms(F.col("query")))
    both = F.arrays_overlap(_lowered(_list(rows, "actors")), F.col("__actors")) & F.arrays_overlap(_lowered(_list(rows, "platforms")), F.col("__platforms"))
    all_stay = (F.size("__platforms") == 0) | (F.size("__actors") == 0)
    return rows.where(all_stay | (F.coalesce(F.col("node_type"), F.lit("")) == "Actor") | both).drop("__actors", "__platforms")


def unresolved(rows: DataFrame) -> DataFrame:
    """(query_id) of queries that name an entity which no text of their rows has."""
    single = [c for c in ("name", "external_id", "node_id", "id", "description", "parent_technique") if c in rows.columns]
    many = [c for c in ("aliases", "tactics", "platforms", "techniques", "actors", "malware", "tools", "campaigns", "mitigations", "detections", "analytics", "log_sources", "log_source_names", "detection_strategies", "subtechniques") if c in rows.columns]
    texts = F.transform(F.concat(F.array(*[F.col(c).cast("string") for c in single]), *[_list(rows, c) for c in many]), X.compact)
    asked = rows.withColumn("__texts", texts).select("query_id", "__texts", F.explode(X.reference_tokens(F.col("query"))).alias("token"))
    found = asked.groupBy("query_id", "token").agg(F.max(F.exists("__texts", lambda t: F.contains(t, F.col("token"))).cast("int")).alias("found"))
    return found.where("found = 0").select("query_id").distinct()


def shared(left: Column, right: Column) -> Column:
    """Values of left that right has in any case, order and repeats kept."""
    low = _lowered(right)
    return F.filter(left, lambda x: F.array_contains(low, F.lower(x)))


def examples(items: Column, most: int = V.COMPARED_ITEMS) -> Column:
    text = F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, F.lit(", ...")).otherwise(F.lit("")))
    return F.when(F.size(items) == 0, F.lit("None shown in context")).otherwise(text)


def comparisons(rows: DataFrame) -> DataFrame:
    """(query_id, answer) for queries that compare and name two actors among their rows: the first two, by pos."""
    fields = [("Tactics", "tactics"), ("Techniques", "techniques"), ("Malware", "malware"), ("Tools", "tools"), ("Campaigns", "campaigns")]
    actors = top(rows.where(X.is_comparison(F.col("query")) & is_mentioned_actor()).withColumnRenamed("pos", "__pos"), 2, [F.asc("__pos")])
    own = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("external_id", "node_id", "id") if c in rows.columns], F.lit("None"))
    node = F.struct("name", own.alias("own"), X.blank(F.col("description")).alias("description"), *[_list(rows, k).alias(k) for _, k in fields])
    pair = actors.groupBy("query_id").agg(F.max(F.when(F.col("pos") == 0, node)).alias("l"), F.max(F.when(F.col("pos") == 1, node)).alias("r")).where("r is not null")
    lines = [F.concat(F.lit("Comparison: "), F.col("l.name"), F.lit(" ("), F.col("l.own"), F.lit(") vs "), F.col("r.name"), F.lit(" ("), F.col("r.own"), F.lit(")")), F.lit("")]
    lines += [F.when(F.col(f"{s}.description") != "", F.concat(F.col(f"{s}.name"), F.lit(": "), F.substring(f"{s}.description", 1, 300))) for s in "lr"]
    for label, key in fields:
        a, b = F.col(f"l.{key}"), F.col(f"r.{key}")
        block = F.concat_ws("\n", F.lit(""), F.lit(f"{label}:"), F.concat(F.lit("- Shared examples: "), examples(shared(a, b))), F.concat(F.lit("- "), F.col("l.name"), F.lit(" examples: "), examples(a)), F.concat(F.lit("- "), F.col("r.name"), F.lit(" examples: "), examples(b)))
        lines.append(F.when((F.size(a) > 0) | (F.size(b) > 0), block))
    return pair.select("query_id", F.concat_ws("\n", *lines, F.lit(""), F.lit(V.COMPARISON_NOTE)).alias("answer"))


def listed(items: Column, query: Column, comparing: Column) -> Column:
    """Values as text, those that the query mentions first: five of them when comparing, else as many as fit into the
    characters of a field (the first always), with ... after a cut."""
    said = F.filter(items, lambda x: X.mentions(x, query))
    ordered = F.concat(said, F.filter(items, lambda x: ~F.array_contains(said, x)))
    # the size that the text reaches with each value only grows, so that values are kept up to the first that does not fit
    none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("fits"), F.lit(False).alias("begun"))

    def reach(acc: Column, x: Column) -> Column:
        size = acc.size + F.when(acc.begun, F.lit(2)).otherwise(F.lit(0)) + F.length(x)
        return F.struct(size.alias("size"), (acc.fits + F.when(size <= V.FIELD_CHARS, F.lit(1)).otherwise(F.lit(0))).alias("fits"), F.lit(True).alias("begun"))

    fits = F.aggregate(ordered, none, reach).getField("fits")
    count = F.when(comparing, F.lit(V.COMPARED_ITEMS)).otherwise(F.greatest(fits, F.lit(1)))
    return F.concat(F.array_join(F.slice(ordered, 1, count), ", "), F.when(F.size(ordered) > count, F.lit(", ...")).otherwise(F.lit("")))


def blocks(rows: DataFrame) -> DataFrame:
    """rows with block: a numbered text of each node, in the order of pos."""
    numbered = top(rows.withColumnRenamed("pos", "__pos"), None, [F.asc("__pos")])
    named = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    comparing, platforms = X.is_comparison(F.col("query")), F.size(X.query_platforms(F.col("query"))) > 0
    own = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("external_id", "node_id", "id") if c in rows.columns])
    lines = [F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), named("node_type", "Unknown"), F.lit(" - "), named("name", "Unknown")), F.concat(F.lit("ID: "), own), F.when(X.blank(F.col("description")) != "", F.concat(F.lit("Description: "), F.substring("description", 1, V.DESCRIPTION_CHARS)))]
    for label, key in V.CONTEXT_FIELDS:
        source = "log_source_names" if key == "log_sources" and "log_source_names" in rows.columns else key
        if source not in rows.columns:
            continue
        if rows.schema[source].dataType.typeName() == "array":
            items = _list(rows, source)
            line = F.when(F.size(items) > 0, F.concat(F.lit(label), F.when(comparing, F.lit(" Examples: ")).otherwise(F.lit(": ")), listed(items, F.col("query"), comparing)))
        else:
            line = F.when(F.col(source) != "", F.concat(F.lit(f"{label}: "), F.col(source)))
        if key in ("techniques", "malware", "tools"):
            line = F.when(~(platforms & (F.coalesce(F.col("node_type"), F.lit("")) == "Actor")), line)
        lines.append(line)
    return numbered.withColumn("block", F.concat_ws("\n", *lines))


def contexts(rows: DataFrame) -> DataFrame:
    """(query_id, query, context): the blocks of each query."""
    each = blocks(rows).groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("b"))
    return each.select("query_id", "query", F.array_join(F.transform("b", lambda x: x.block), "\n\n---\n\n").alias("context"))


def answers(queries: DataFrame, rows: DataFrame, filters: DataFrame | None = None, generator: Generator | None = None) -> DataFrame:
    """(query_id, answer, context) of queries(query_id, query) given ranked rows(query_id, pos, nodes' columns).

    Without rows, or with a name that the rows do not have, there is no answer; comparisons answer themselves; else the
    generator does, or without one the context is the answer.
    """
    rows = platform_actor_filter(rows.drop("query").join(queries.select("query_id", "query"), "query_id"))
    refused = unresolved(rows).withColumn("__refused", F.lit(True))
    compared = comparisons(rows).withColumnRenamed("answer", "__compared")
    out = queries.select("query_id", "query").join(contexts(rows).drop("query"), "query_id", "left").join(refused, "query_id", "left").join(compared, "query_id", "left")
    fixed = F.when(F.col("context").isNull() | F.col("__refused"), F.lit(V.NO_ANSWER)).otherwise(F.col("__compared"))
    out = out.withColumn("answer", fixed)
    if generator is None:
        return out.select("query_id", F.coalesce("answer", "context").alias("answer"), "context")
    told = out.join(filters.select("query_id", F.to_json("filters").alias("__filters")), "query_id", "left") if filters is not None else out.withColumn("__filters", F.lit(""))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["answer"] = [a if isinstance(a, str) else generator.answer(q, c, f or "") for q, c, f, a in zip(pdf["query"], pdf.context, pdf.filters, pdf.answer, strict=True)]
            yield pdf[["query_id", "answer", "context"]]

    return told.select("query_id", "query", "context", F.col("__filters").alias("filters"), "answer").mapInPandas(run, f"query_id {kind}, answer string, context string")
