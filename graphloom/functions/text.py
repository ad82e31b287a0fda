"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import values as V


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def or_empty(items: Column) -> Column:
    return F.coalesce(items, empty_strings())


def blank(text: Column) -> Column:
    """Null as ''."""
    return F.coalesce(text, F.lit(""))


def compact(text: Column) -> Column:
    """Lower-case letters and digits of a text and nothing else."""
    return F.regexp_replace(F.lower(blank(text)), "[^a-z0-9]+", "")


def normalize(text: Column) -> Column:
    """Trimmed, white space as single spaces, lower case; null as ''."""
    return F.lower(F.regexp_replace(F.regexp_replace(blank(text), r"^\s+|\s+$", ""), r"\s+", " "))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(blank(text), F.lit(pattern), F.lit(group))


def full_text_query(text: Column) -> Column:
    """A text without the operators of full-text syntax, white space collapsed."""
    plain = F.regexp_replace(blank(text), r"&&|\|\|", " ")
    plain = F.regexp_replace(plain, r'[+!(){}\[\]^"~*?:\\/-]', " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


#: Words of full-text syntax; in capitals only.
AND, OR, NOT = "AND", "OR", "NOT"


def clauses(text: Column) -> Column:
    """Words of a full-text query with what is asked of each: 1 if it must be there, -1 if it must not, else 0.

    Both sides of AND must be there, a word after NOT must not, OR asks nothing; an operator without a word on a side that
    needs one asks nothing either.
    """
    w = F.filter(F.split(full_text_query(text), " "), lambda x: x != "")
    operator = lambda x: F.coalesce(x.isin(AND, OR, NOT), F.lit(False))
    at = lambda i: F.get(w, i)

    def occur(x: Column, i: Column) -> Column:
        banned = F.coalesce(at(i - 1) == NOT, F.lit(False))
        before = F.when(banned, i - 2).otherwise(i - 1)
        joined = (F.coalesce(at(before) == AND, F.lit(False)) & (before > 0)) | (F.coalesce(at(i + 1) == AND, F.lit(False)) & at(i + 2).isNotNull())
        return F.when(~operator(x), F.struct(x.alias("word"), F.when(banned, -1).when(joined, 1).otherwise(0).alias("occur")))

    return F.filter(F.transform(w, occur), lambda c: c.isNotNull())


def clean_expansion(text: Column) -> Column:
    """An expanded query without bullet, number and quotes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(blank(text), r"^\s+|\s+$", ""), r"^\s*(?:[-*]|\d+[).])\s*", ""), "^[ \"']+|[ \"']+$", "")


def tokens(text: Column) -> Column:
    """Words of three ASCII letters or digits and more, in order; only those with no other word character beside them."""
    return find_all(F.lower(blank(text)), r"(?U)\b[a-z0-9]{3,}\b")


def content(words: Column) -> Column:
    """Words that are neither stop words nor structural words, order kept."""
    known = strings(V.STOPWORDS + V.STRUCTURAL)
    return F.filter(words, lambda w: ~F.array_contains(known, w))


def content_tokens(text: Column) -> Column:
    return F.array_distinct(content(tokens(text)))


def words(text: Column) -> Column:
    """Words of a text in lower case."""
    return find_all(F.lower(blank(text)), r"(?U)\b\w+\b")


def ngrams(text: Column, most: int = 4) -> Column:
    """All runs of 1 to most words, shorter first, by position."""
    w = words(text)

    def of(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return F.flatten(F.array(*[of(n) for n in range(1, most + 1)]))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.substr(a, i, F.lit(1)) != ""), i).otherwise(n),
    )


def mentions(value: Column, query: Column) -> Column:
    """Whether a value that is not empty is part of the query, in any case."""
    return F.coalesce((value != "") & (query != "") & F.contains(F.lower(query), F.lower(value)), F.lit(False))


def unique(items: Column) -> Column:
    """Items trimmed, empty ones dropped, of those equal after normalize() the first; order kept."""
    kept = F.filter(F.transform(or_empty(items), lambda x: F.regexp_replace(blank(x), r"^\s+|\s+$", "")), lambda x: x != "")
    return F.aggregate(kept, empty_strings(), lambda acc, x: F.when(F.exists(acc, lambda y: normalize(y) == normalize(x)), acc).otherwise(F.array_append(acc, x)))


def any_equal(needles: Column, haystack: Column) -> Column:
    """Whether some needle equals some item after normalize()."""
    hay = F.transform(or_empty(haystack), normalize)
    return F.exists(or_empty(needles), lambda n: F.array_contains(hay, normalize(n)))


def clip(x: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def json_object(text: Column) -> Column:
    """The JSON object of a model's answer: without code fence, from the first { to the last }; {} if that is none."""
    plain = F.regexp_replace(F.replace(F.replace(blank(text), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(inner).isNotNull(), inner).otherwise(F.lit("{}"))


# --- extractors -------------------------------------------------------------------------------------------------------
def external_ids(query: Column) -> Column:
    """Upper-case external identifiers in a query, sorted and distinct."""
    return F.sort_array(F.array_distinct(F.transform(find_all(query, V.EXTERNAL_ID), F.upper)))


def referenced_ids(query: Column) -> Column:
    """External and CVE identifiers, upper case, sorted and distinct."""
    return F.sort_array(F.array_distinct(F.concat(external_ids(query), F.transform(find_all(query, V.CVE_ID), F.upper))))


def reference_tokens(query: Column) -> Column:
    """Compacted tokens that look like names of entities and are no identifiers, sorted and distinct."""
    whole = lambda p: "(?i)^(?:" + p.removeprefix("(?i)") + ")$"
    found = F.filter(find_all(query, V.ENTITY_REFERENCE), lambda t: ~t.rlike(whole(V.EXTERNAL_ID)) & ~t.rlike(whole(V.CVE_ID)))
    return F.sort_array(F.array_distinct(F.transform(found, compact)))


def node_types(query: Column, in_search: bool = False) -> Column:
    """Types that a query asks for in the plural; without one, those it names in the singular; in the fixed order."""
    named = lambda table: F.filter(F.array(*[F.when(blank(query).rlike(p), F.lit(t)) for t, p in table]), lambda t: t.isNotNull())
    asked = named(V.REQUESTED_TYPES_IN_SEARCH if in_search else V.REQUESTED_TYPES)
    return F.when(F.size(asked) > 0, asked).otherwise(named(V.QUALIFIER_TYPES))


def low_signal(query: Column) -> Column:
    return blank(query).rlike(V.LOW_SIGNAL)


def query_platforms(query: Column) -> Column:
    """Platform terms that are part of a query."""
    low = F.lower(blank(query))
    return F.filter(strings(V.PLATFORM_TERMS), lambda p: F.contains(low, p))


def is_comparison(query: Column) -> Column:
    low = F.lower(blank(query))
    return F.exists(strings(V.COMPARISON_TERMS), lambda t: F.contains(low, t))


def campaign_phrases(query: Column) -> Column:
    """For each phrase before campaign or operation, its suffixes, longest first."""
    phrases = F.transform(find_all(query, "(?U)" + V.CAMPAIGN_PHRASE, 1), F.lower)
    return F.transform(phrases, lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, r"\s+"))), lambda i: F.array_join(F.slice(F.split(p, r"\s+"), i, F.size(F.split(p, r"\s+"))), " ")))


def descriptor_words(description: Column) -> Column:
    """The nouns that a description says its subject is: the last content word of each 'is a ...' phrase."""
    plain = F.regexp_replace(F.lower(blank(description)), V.LINK, " ")
    phrases = F.transform(find_all(plain, V.DESCRIPTOR, 1), lambda p: F.get(F.split(p, V.DESCRIPTOR_END, 2), F.lit(0)))
    last = F.transform(phrases, lambda p: F.try_element_at(content(tokens(p)), F.lit(-1)))
    return F.array_distinct(F.filter(last, lambda w: w.isNotNull()))
