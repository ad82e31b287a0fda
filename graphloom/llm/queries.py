"""The queries opN_<name> over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import collocations, exact_dedup, hnsw, langid, licenses, mixing, packing, quality, secrets, simhash, tokens, url_rules, variants, warc
from graphloom.llm.base import held_out

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)
    component = F.col("component").alias("component_id")
    return found.select(F.col("id").alias("vec_id"), "n_links", component, F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(tokens.token_counts(docs)).withColumnRenamed("id", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    return mixing.rates(docs, labelled).withColumnRenamed("id", "doc_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*secrets.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in secrets.BASE], digest, joined(F.col("spans")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


#: Fixed by the contract of op10: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS t(verdict, host, path)")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules, carry=("page_id",))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.NOTICES, licenses.PHRASES)
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_url_filter": op10_url_filter,
    "op11_license_scan": op11_license_scan,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _templates(found: list[licenses.Template]) -> str:
    """Rows (label, phrase, tokens, needed) for SQL."""
    return ", ".join(f"('{t.label}', {_quoted(t.words)}, {_quoted(sorted(set(t.words)))}, {t.needed})" for t in found)


_A, _Z = licenses.UPPER, licenses.LOWER

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                             WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                 WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r),
        c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
        SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN c ON c.id = e.vec_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM d""",
    "op10_url_filter": """
        WITH rules(verdict, host, path) AS (VALUES """
    + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    + """),
        u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
        k AS (SELECT DISTINCT host, path FROM p),
        w AS (SELECT k.host, k.path, r.host || r.path AS rule, r.verdict
              FROM k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
              QUALIFY row_number() OVER (PARTITION BY k.host, k.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1)
        SELECT p.page_id, p.host, p.path, w.rule, coalesce(w.verdict, 'allow') AS verdict
        FROM p LEFT JOIN w ON p.host = w.host AND p.path = w.path""",
    "op11_license_scan": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        base(label, phrase, tokens, needed) AS (VALUES {_templates(licenses.PHRASES)}),
        more(label, phrase, tokens, needed) AS (VALUES {_templates(licenses.NOTICES)}),
        b AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = phrase[1] AND ws[i + 1:i + len(phrase)] = phrase)) AS place
              FROM d JOIN base ON list_has_all(ws, tokens)),
        m AS (SELECT doc_id, label, len(tokens) AS most, list_max(list_transform(
                  list_filter(range(len(ws)), lambda i: list_contains(tokens, ws[i + 1])),
                  lambda i: len(list_distinct(list_intersect(ws[i + 1:i + len(phrase)], tokens))))) AS held, needed
              FROM d JOIN more ON len(list_intersect(ws, tokens)) >= needed),
        found AS (SELECT doc_id, label, true AS is_base, place, 1.0::DOUBLE AS score FROM b
                  UNION ALL SELECT doc_id, label, false, NULL, held::DOUBLE / most FROM m WHERE held >= needed),
        g AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(place) AS first_word, max(place) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN g USING (doc_id)""",
    "op12_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
        t AS (SELECT lang, ws[i + 1:i + k] AS g FROM (SELECT lang, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
        f AS (SELECT lang, g, array_to_string(g, ' ') AS phrase, count(*) AS c FROM t GROUP BY lang, g),
        n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
        h AS (SELECT * FROM f WHERE c >= 100),
        gone AS (SELECT DISTINCT s.lang, s.g FROM h s JOIN h o ON s.lang = o.lang AND len(o.g) > len(s.g) AND 100 * o.c >= 100 * s.c
                 AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')),
        k AS (SELECT lang, g, phrase, c, unnest(range(1, len(g))) AS k FROM h ANTI JOIN gone USING (lang, g) WHERE len(g) > 1),
        s AS (SELECT k.lang, k.phrase, k.c AS a, l.c AS l, r.c AS r, n.n, (1000::HUGEINT * k.c * n.n) // (l.c::HUGEINT * r.c) AS score
              FROM k JOIN h l ON l.lang = k.lang AND l.g = k.g[1:k.k] JOIN h r ON r.lang = k.lang AND r.g = k.g[k.k + 1:len(k.g)] JOIN n ON n.lang = k.lang
              QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM s QUALIFY rank <= 2000""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS of
                               FROM (SELECT unnest(range(256)) AS n)),
        o AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[a-zÀ-ÿ]+')) AS run FROM documents)
              WHERE length(run) >= 6 GROUP BY ALL),
        x AS (SELECT run, c, hex(encode(doc_id || ':' || run)) AS h FROM o),
        y AS (SELECT run, c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                     lambda a, b: xor(crc.of[(xor(a, b) & 255) + 1], a >> 8))) AS h FROM x, crc),
        z AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM y),
        v AS (SELECT word, sum(c)::BIGINT AS n FROM z WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
        cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
        near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                 UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.rest = v.word
                 UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.rest = v.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n
              FROM v LEFT JOIN best USING (word)),
        way(word, root) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n
        FROM f JOIN way USING (word) JOIN f e ON e.word = way.root AND e.form IS NULL""",
}
