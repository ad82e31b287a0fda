"""Which questions are answered at all."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions import values as V
from graphloom.operators.ports import Judge


def blacklist(queries: DataFrame) -> DataFrame:
    """queries with allowed, category and message; category and message are null where allowed."""
    text = X.blank(F.col("query"))
    category = F.when(text.rlike(V.OFF_TOPIC), F.lit("clearly_offtopic")).when(text.rlike(V.JAILBREAK), F.lit("jailbreak"))
    message = F.try_element_at(F.create_map(*[F.lit(x) for pair in V.BLOCKED.items() for x in pair]), F.coalesce("category", F.lit("")))
    return queries.withColumn("category", category).withColumn("allowed", F.col("category").isNull()).withColumn("message", message)


def guard(queries: DataFrame, judge: Judge | None = None) -> DataFrame:
    """blacklist(), and then what a judge says of the queries it left; an answer that cannot be read allows."""
    seen = blacklist(queries)
    if judge is None:
        return seen

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in pdf.index[pdf.allowed]:
                answer = judge.judge(pdf.at[i, "query"])
                try:
                    told = json.loads(answer.strip())
                    allowed, reason = bool(told["allowed"]), told.get("reason", "")
                except (ValueError, TypeError, KeyError):
                    continue
                if not allowed:
                    pdf.loc[i, ["allowed", "category", "message"]] = [False, "llm_blocked", f"I'm a cybersecurity assistant. I can't help with that. {reason}"]
            yield pdf

    return seen.mapInPandas(run, seen.schema)
