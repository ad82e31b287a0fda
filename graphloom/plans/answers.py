"""Queries of what stands around questions and models' answers: hints, filters, scores, cards, fused order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions import values as V
from graphloom.operators import entities, guard, rerank, search
from graphloom.plans.queries import ASKED, FUSED, LCS, MADE, _legs, _literal, _misspelt, chosen, joined, query, questions, table
from graphloom.sources import bundle, scratch

def part_key() -> Column:
    return F.col("p_partkey")


# --- text -------------------------------------------------------------------------------------------------------------
#: What a model writes around its JSON, and what it may write instead.
AROUND = [("", ""), ("```json\n", "\n```"), ("so: ", " that is it"), ("{", "}"), ("[", "]"), ("no ", "json"), ("  ", "\n\n"), ("```", "``` ")]


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 8 IN (3, 5) THEN '{{}}' ELSE '{{"name": "' || p_name || '", "size": ' || p_size || '}}' END AS found FROM part""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in a model's answer about a part, whatever stands around it."""
    body = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    body = F.when(part_key() % 8 == 5, F.lit("at all")).otherwise(body)
    answer = F.concat(chosen([a for a, _ in AROUND], part_key() % 8), body, chosen([b for _, b in AROUND], part_key() % 8))
    return table(spark, sf_dir, "part").select("p_partkey", X.json_object(answer).alias("found"))


@query("""SELECT a.p_partkey, coalesce(list_max(list_filter(range(1, least(length(a.p_name), length(b.p_name)) + 1), lambda i: left(a.p_name, i) = left(b.p_name, i))), 0)::INT AS n
          FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the names of neighbouring parts have in common at the beginning."""
    part = table(spark, sf_dir, "part")
    other = part.select((part_key() - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", X.common_prefix(F.col("p_name"), F.col("other")).alias("n"))


@query(f"""SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all('What of the ' || p_name || CASE p_partkey % 3 WHEN 0 THEN ' Campaign' WHEN 1 THEN ' operations, or the blue-ring campaign' ELSE ' party' END || ' by ' || p_brand,
              {_literal(V.CAMPAIGN_PHRASE)}, 1), lambda p: lower(p)), 'string_agg', '|') AS phrases FROM part""")
def campaign_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words before campaign or operation; of a phrase's suffixes the longest comes first."""
    text = F.concat(F.lit("What of the "), "p_name", chosen([" Campaign", " operations, or the blue-ring campaign", " party"], part_key() % 3), F.lit(" by "), "p_brand")
    found = F.transform(X.campaign_phrases(text), lambda s: F.get(s, F.lit(0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.size(found) > 0, joined(found)).alias("phrases"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN string_split(p_name, ' ')[-1] WHEN 1 THEN lower(p_type) WHEN 2 THEN list_sort([string_split(p_name, ' ')[-1], 'gadget'])[1] || '|' || list_sort([string_split(p_name, ' ')[-1], 'gadget'])[2] END AS words FROM part""")
def descriptor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What descriptions say that their subject is: up to the first word that ends it, links aside."""
    text = F.when(part_key() % 4 == 0, F.concat(F.lit("It is a "), "p_name", F.lit(" that runs. And more.")))
    text = text.when(part_key() % 4 == 1, F.concat(F.lit("[This](x/y) was the "), "p_type", F.lit(" used by [A](b), or not")))
    text = text.when(part_key() % 4 == 2, F.concat(F.lit("One is an "), "p_name", F.lit("; others are the big gadget (or so)"))).otherwise(F.lit("Nothing of the kind"))
    words = X.descriptor_words(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.size(words) > 0, joined(F.sort_array(words))).alias("words"))


# --- dictionaries and hints -------------------------------------------------------------------------------------------
def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes of four types, so that types share names; alike in capitals only."""
    kind = chosen(["Tool", "Malware", "Actor", "Campaign"], part_key() % 4)
    name = F.when(part_key() % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("n"), part_key().cast("string")).alias("id"), kind.alias("node_type"), name.alias("name"), F.array(F.lower("p_brand")).alias("aliases"), F.lit("").alias("description"), F.lit(None).cast("string").alias("shortname"))


KINDS = """k AS (SELECT ['tool', 'malware', 'threat_actor', 'campaign'][p_partkey % 4 + 1] AS field, [3, 2, 1, 4][p_partkey % 4 + 1] AS rank, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, lower(p_brand) AS alias FROM part),
    i AS (SELECT field, any_value(rank) AS rank, key, max(name) AS real_name FROM (SELECT field, rank, name AS key, name FROM k UNION ALL SELECT field, rank, alias, name FROM k WHERE field <> 'campaign') GROUP BY field, key),
    x AS (SELECT lower(key) AS key, max((rank, real_name, field)) AS m FROM i GROUP BY 1)"""


@query(f"WITH {KINDS} SELECT key, m[2] AS real_name, m[3] AS type FROM x")
def dictionary_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fields that share a key the last in precedence has it."""
    return entities.global_index(_kinds(spark, sf_dir))


@query(f"""WITH {KINDS}, {MADE}, g AS (SELECT s_suppkey, unnest(list_concat(t, [array_to_string(t[1:2], ' ')] , CASE WHEN len(t) > 2 THEN [array_to_string(t[2:3], ' '), array_to_string(t[1:3], ' ')] ELSE [] END)) AS c
              FROM (SELECT s_suppkey, regexp_extract_all(word, '[a-z0-9_]+') AS t FROM m)),
           d AS (SELECT DISTINCT s_suppkey, c FROM g WHERE length(c) >= 4 AND NOT regexp_matches(c, '^[gmstc]a?[0-9]{{4}}')),
           r AS (SELECT c, key, 200.0 * list_last({LCS.format(a="c", b="key")}) / (length(c) + length(key)) AS score FROM (SELECT DISTINCT c FROM d), (SELECT key FROM x)),
           b AS (SELECT c, key FROM r WHERE score >= 65 QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, key) = 1)
           SELECT DISTINCT s_suppkey::INT AS query_id, m[3] AS type, m[2] AS real_name FROM d JOIN b USING (c) JOIN x USING (key) WHERE length(m[2]) >= 4""")
def loose_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one key that each run of words of a misspelt name resembles most."""
    asked = _misspelt(spark, sf_dir).select(F.col("s_suppkey").cast("int").alias("query_id"), F.col("word").alias("query"))
    return entities.loose_hints(asked, _kinds(spark, sf_dir))


#: Order lines as hints: an order asks, a line's shipping mode is the field's value.
HINTED = """h AS (SELECT l_orderkey AS query_id, CASE WHEN l_linenumber % 2 = 0 THEN 'tool' ELSE 'malware' END AS field, 'v' || (l_partkey % 3) AS value, (l_suppkey % 4)::INT AS stage, l_linenumber::INT AS place,
                      left(l_returnflag || l_linestatus || l_partkey, 1 + l_linenumber % 5) AS source_text, (70 + l_quantity % 7)::DOUBLE AS score FROM lineitem),
    s AS (SELECT query_id, field, value, list({'stage': stage, 'place': place, 'source_text': source_text, 'score': score} ORDER BY stage, place, source_text, score) AS items FROM h GROUP BY ALL),
    f AS (SELECT query_id, field, value, items[1] AS f, list_reduce(items, lambda o, n: CASE WHEN n.score > o.score + 2 OR (abs(n.score - o.score) <= 2 AND length(n.source_text) < length(o.source_text)) THEN n ELSE o END) AS k FROM s),
    r AS (SELECT query_id, field, value, k.source_text AS source_text, k.score AS score, row_number() OVER (PARTITION BY query_id, field ORDER BY f.stage, f.place, value)::INT - 1 AS pos FROM f)"""


def _hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    source = F.expr("left(concat(l_returnflag, l_linestatus, l_partkey), 1 + l_linenumber % 5)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.when(line % 2 == 0, "tool").otherwise("malware").alias("field"), F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("value"), (F.col("l_suppkey") % 4).cast("int").alias("stage"), line.cast("int").alias("at"), source.alias("source_text"), (70 + F.col("l_quantity") % 7).cast("double").alias("score"))


@query(f"WITH {HINTED} SELECT * FROM r")
def merged_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a value's hints each replaces the one before if it is clearly better, or as good and shorter."""
    return entities.merge_hints(_hinted(spark, sf_dir))


@query(f"""WITH {HINTED}, t AS (SELECT query_id, field, 'Potential ' || field || ' mentioned: ' || string_agg(value || ' from ''' || source_text || '''', ', ' ORDER BY pos) AS line FROM r GROUP BY query_id, field)
           SELECT query_id, string_agg(line, chr(10) ORDER BY line) AS hints FROM t GROUP BY query_id""")
def hint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints as a model is told of them."""
    return entities.hint_text(scratch.materialise(entities.merge_hints(_hinted(spark, sf_dir)), "hints"))


# --- guard and models' answers ----------------------------------------------------------------------------------------
class _Judge:
    """A stand-in: refuses questions about tools, says nothing readable of those about campaigns."""

    def judge(self, query: str) -> str:
        return '{"allowed": false, "reason": "no tools"}' if "tool" in query else "maybe" if "ampaign" in query else '{"allowed": true}'


@query(f"""WITH {ASKED}, c AS (SELECT *, CASE WHEN regexp_matches(query, {_literal(V.OFF_TOPIC)}) THEN 'clearly_offtopic' WHEN regexp_matches(query, {_literal(V.JAILBREAK)}) THEN 'jailbreak' WHEN contains(query, 'tool') THEN 'llm_blocked' END AS category FROM q)
           SELECT query_id, category IS NULL AS allowed, category, CASE category {" ".join(f"WHEN '{k}' THEN {_literal(v)}" for k, v in V.BLOCKED.items())} WHEN 'llm_blocked' THEN 'I''m a cybersecurity assistant. I can''t help with that. no tools' END AS message FROM c""")
def judged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns first, then a judge; what cannot be read allows."""
    return guard.guard(questions(spark, sf_dir), _Judge()).select("query_id", "allowed", "category", "message")


@query("""WITH a AS (SELECT s_suppkey, unnest([0, 1, 2, 3]) AS place FROM supplier),
          e AS (SELECT s_suppkey, place, CASE WHEN place = 3 THEN 0 ELSE place END AS i, CASE place WHEN 0 THEN s_suppkey % 13 WHEN 1 THEN s_suppkey / 10.0 WHEN 2 THEN NULL ELSE -1 END::DOUBLE AS s FROM a WHERE place < 3 OR s_suppkey % 5 = 0)
          SELECT s_suppkey AS query_id, i::INT AS index, least(10, greatest(0, arg_max(s, place))) AS score FROM e WHERE s IS NOT NULL AND s_suppkey % 6 <> 5 GROUP BY s_suppkey, i""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that a model states: clipped; unreadable ones and answers are left out, the last of two for an index counts."""
    key = F.col("s_suppkey")
    entry = lambda i, s: F.concat(F.lit(f'{{"index": {i}, "score": '), s, F.lit("}"))
    more = F.when(key % 5 == 0, F.concat(F.lit(", "), entry(0, F.lit("-1")))).otherwise(F.lit(""))
    body = F.concat(F.lit('so: {"scores": ['), entry(0, (key % 13).cast("string")), F.lit(", "), entry(1, F.format_string('"%.1f"', key / 10.0)), F.lit(", "), entry(2, F.lit('"high"')), more, F.lit("]}"))
    answers = table(spark, sf_dir, "supplier").select(key.alias("query_id"), F.when(key % 6 == 5, F.lit("none")).otherwise(body).alias("answer"))
    return rerank.told_scores(answers).select("query_id", F.col("__index").alias("index"), F.col("llm_score").alias("score"))


@query(f"""WITH {ASKED}, s AS (SELECT query_id, query, query_id % 4 AS k FROM q),
           v AS (SELECT query_id, 'tool' AS field, unnest([CASE WHEN k = 0 THEN 'tools' WHEN k = 1 THEN 'Windows' ELSE 'nowhere' END, CASE WHEN k = 3 THEN 'that' END]) AS value, query FROM s)
           SELECT query_id, field, value, row_number() OVER (PARTITION BY query_id ORDER BY value <> 'that')::INT - 1 AS pos FROM v WHERE value IS NOT NULL AND contains(lower(query), lower(value)) AND value <> 'that'""")
def grounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what a model states only what its words in the question bear out, and what is not made of generic words."""
    asked = questions(spark, sf_dir)
    k = F.col("query_id") % 4
    value = chosen(["tools", "Windows", "nowhere", "nowhere"], k)
    answer = F.concat(F.lit('{"tool": [{"value": "'), value, F.lit('", "source_text": "'), value, F.lit('"}'), F.when(k == 3, F.lit(', "that"')).otherwise(F.lit("")), F.lit('], "shoe_size": "9"}'))

    class Known:
        keys = asked.select(F.lit("key").alias("key")).limit(1)
        generic = asked.select(F.lit("that").alias("token")).limit(1)

    told = entities.told_entities(asked.select("query_id", answer.alias("answer")))
    hints = asked.select("query_id", F.lit("").alias("field"), F.lit("").alias("value"), F.lit("").alias("source_text")).limit(0)
    return entities.grounded(told, asked, hints, Known())


@query("""SELECT p_partkey, 'Name: ' || p_name || chr(10) || 'Type: Tool' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'ID: T' || (1000 + p_partkey % 9000) ELSE '' END || chr(10) || 'Aliases: ' || p_brand
              || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE chr(10) || 'Description: ' || left(repeat(p_type || '.', 60), 350) END || chr(10) || 'Platforms: '
              || array_to_string(list_transform(range(least(5, 1 + p_size % 8)), lambda i: 'p' || i), ', ') AS card FROM part""")
def node_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node as a model is shown it: long texts cut, lists of five."""
    external = F.when(part_key() % 2 == 0, F.concat(F.lit("T"), (1000 + part_key() % 9000).cast("string")))
    described = F.when(part_key() % 3 != 0, F.repeat(F.concat("p_type", F.lit(".")), F.lit(60)))
    platforms = F.transform(F.sequence(F.lit(0), (F.col("p_size") % 8).cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.lit("Tool").alias("node_type"), external.alias("external_id"), F.array("p_brand", "p_brand").alias("aliases"), described.alias("description"), platforms.alias("platforms"))
    return rows.select("p_partkey", rerank.card(rows).alias("card"))


# --- order ------------------------------------------------------------------------------------------------------------
@query(f"""WITH {FUSED}, y AS (SELECT query_id, id, 0 AS leg, pos, s AS score FROM (SELECT q.vec_id::INT AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT - 1 AS pos,
              list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE pos < 20 UNION ALL SELECT query_id, id, 1, pos, score FROM b WHERE pos < 20),
           z AS (SELECT query_id, id, sum(1.0::DOUBLE / (61 + pos)) AS rrf, min((leg, pos)) AS first, arg_min(score, (leg, pos)) AS score FROM y GROUP BY ALL)
           SELECT query_id, id, round(score, 6) AS source_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, id)::INT - 1 AS pos FROM z""")
def rrf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused order, and the score of the leg that found a node first."""
    return search.fuse(_legs(spark, sf_dir)[1]).select("query_id", "id", F.round("source_score", 6).alias("source_score"), "pos")


@query("""SELECT 'actors' AS name, count(*) AS n FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'campaigns', count(*) FROM nation""")
def tables_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as they are written, counted in what was written."""
    actors = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    campaigns = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    counts = bundle.write_tables({"actors": actors, "campaigns": campaigns}, scratch.folder(spark, "tables"), "json")
    return counts.select(F.col("table").alias("name"), F.col("rows").alias("n"))
