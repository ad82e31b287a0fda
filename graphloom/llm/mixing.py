"""Mixing to target weights with soft membership in domains.

A classifier learned from a labelled table gives each document a posterior over domains. Projected-gradient least squares
then fits a rate for each document, never below a floor (zero, if not asked otherwise), such that the tokens expected of
each domain meet its target. Main path: DataFrame functions only; what reaches the driver is a few numbers a domain.

The gradient of a document's rate is its posterior times a vector that all documents share, so that steps add up to one such
vector: a rate is max(floor, 1 - posterior * steps), projected anew from where it began. Each step takes one aggregate over
the documents, which gives the gradient and, of the rates that the floor does not hold, the matrix that scales it; plain
steps would need thousands where targets are harsh. A rate depends on the corpus only through the vector, so it is an
expression of the document's own text: no join brings it back.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import materialise

#: Character n-grams that the classifier counts, and their lengths.
FEATURES, GRAMS = 20, (1, 2, 3)
#: Labelled documents that the classifier learns from: of each domain at most, and of all (but at least one of each).
SAMPLE, SAMPLE_ALL = 256, 8192
#: Counts' worth of doubt that every text has, so that short ones stay near the prior.
DOUBT = 20.0
#: What keeps rates near 1 where targets leave a choice, against the squares of relative misses: less and less, the last one
#: being what counts; the norm of the gradient at which a fit has ended; and steps for each, beyond which it is an error.
HOLDS, ENDED, STEPS = (1e-2, 1e-4, 1e-6, 1e-8), 1e-7, 200
#: A miss of a target by more than this share is warned of.
MISS = 1e-2
WORD = "[^\\x20\\x09-\\x0D]+"


def tokens(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def counts(text: Column, features: list[str]) -> Column:
    """How often each feature is in the text in lower case, as an array of doubles."""
    text = F.lower(F.coalesce(text, F.lit("")))
    size = F.octet_length(text)
    return F.array(*[((size - F.octet_length(F.replace(text, F.lit(f), F.lit("")))) / len(f.encode())).cast("double") for f in features])


@dataclass
class Mix:
    """Features, domains, for each the weights of features and its prior, how much evidence counts, and the fit: the sum of
    its steps, floor, and the domains' tokens: present, wanted and reached."""

    features: list[str]
    domains: list
    weights: list[list[float]]
    priors: list[float]
    scale: float = 1.0
    floor: float = 0.0
    steps: list[float] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)

    def evidence(self, seen: Column) -> list[Column]:
        """For each domain the mean weight of all that counts() has found, DOUBT more speaking for none."""
        total = F.aggregate(seen, F.lit(DOUBT), lambda a, x: a + x)
        told = lambda w: F.aggregate(F.zip_with(seen, F.array(*map(F.lit, w)), lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x)
        return [told(w) / total for w in self.weights]

    def posterior(self, seen: Column) -> list[Column]:
        """Posterior of each domain given the counts, but for a factor that all have."""
        logits = [e * self.scale + math.log(p) for e, p in zip(self.evidence(seen), self.priors, strict=True)]
        most = F.array_max(F.array(*logits))
        return [F.exp(x - most) for x in logits]

    def rate(self, p: list[Column]) -> Column:
        """The rate of a document with these posteriors."""
        move = sum((c * F.lit(float(x)) for c, x in zip(p, self.steps, strict=False)), F.lit(0.0))
        return F.greatest(F.lit(float(self.floor)), F.lit(1.0) - move)


def _columns(k: int) -> list[str]:
    return [f"__p{i}" for i in range(k)]


def with_posteriors(df: DataFrame, mix: Mix, seen: str) -> DataFrame:
    """df with __p0, __p1, ...: normalised posteriors from the counts in column seen."""
    raw = df.withColumn("__raw", F.array(*mix.posterior(F.col(seen))))
    raw = raw.withColumn("__sum", F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x))
    return raw.withColumns({n: F.get("__raw", F.lit(i)) / F.col("__sum") for i, n in enumerate(_columns(len(mix.domains)))}).drop("__raw", "__sum")


def _scale(rows: list[tuple[int, list[float]]], priors: list[float]) -> float:
    """How much evidence is to count so that rows (domain, evidence) are likeliest: by halving the range that has it."""

    def loss(scale: float) -> float:
        out = 0.0
        for y, m in rows:
            logits = [math.log(p) + scale * x for p, x in zip(priors, m, strict=True)]
            most = max(logits)
            out += most + math.log(sum(math.exp(x - most) for x in logits)) - logits[y]
        return out

    low, high = 0.0, 10.0  # of the logarithm with base 2
    for _ in range(24):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(2**a) <= loss(2**b) else (a, high)
    return 2 ** ((low + high) / 2)


def grams(text: Column) -> Column:
    """All character n-grams of a short text, as an array."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    runs = [chars]
    for n in range(1, max(GRAMS)):
        runs.append(F.zip_with(runs[-1], F.slice(chars, n + 1, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b)))
    return F.concat(*[F.filter(runs[n - 1], lambda g: g.isNotNull()) for n in GRAMS])


def learn(docs: DataFrame, labelled: DataFrame, most: int = FEATURES, sample: int = SAMPLE, sample_all: int = SAMPLE_ALL) -> Mix:
    """docs(id, text) and labelled(id, domain) -> a classifier; null ids and domains teach nothing.

    Of each domain at most sample labelled documents are learned from, and of all sample_all or one of each, chosen by hash
    of the id; of an id's several texts the smallest, and all of it. Features are the n-grams whose share of a text tells most of its domain.
    Half of the documents give the features and their weights (logarithms of shares, against their mean over domains), the
    other half how much weights are to count. Without any labelled text there is one domain, null, that all are in.
    """
    known = labelled.where("id is not null and domain is not null").select("id", "domain")
    mark = F.xxhash64(F.lit("mix"), F.col("id"))
    slots = max(1, min(sample, sample_all // max(1, known.agg(F.countDistinct("domain")).first()[0])))
    few = known.groupBy("domain", F.pmod(mark, F.lit(slots)).alias("slot")).agg(F.min_by("id", mark).alias("id"))
    # sample_all rows, or one for each domain
    picked = docs.where("text is not null").join(F.broadcast(few), "id").groupBy("id", "domain", "slot").agg(F.min("text").alias("text"))
    picked = materialise(picked.withColumn("teaches", F.col("slot") % 2 == 0), "mix-sample")
    halves = picked.groupBy("domain").agg(F.sum(F.col("teaches").cast("int")).alias("n")).collect()  # a row for each domain
    if not halves:
        return Mix([], [None], [[]], [1.0])
    domains = sorted((r.domain for r in halves), key=str)
    if alone := [r.domain for r in halves if not r.n]:  # all in the other half
        picked = picked.withColumn("teaches", F.col("teaches") | F.col("domain").isin(alone))
    priors = _priors(known, domains)
    told = picked.where("teaches").select("domain", F.explode(grams(F.lower("text"))).alias("gram")).groupBy("gram", "domain").agg(F.count("*").alias("n"))
    told = materialise(told, "mix-grams")
    sums = told.groupBy("domain").agg(F.sum("n").alias("total"))
    shares = told.join(F.broadcast(sums), "domain").withColumn("share", F.col("n") / F.col("total"))  # sums: a row for each domain
    # share * log(share / mean share) over domains: what a character of the text tells, if it is this n-gram
    mean = F.sum("share") / len(domains)
    tells = (F.sum(F.col("share") * F.log("share")) - F.sum("share") * F.log(mean)).alias("tells")
    best = shares.groupBy("gram").agg(tells).orderBy(F.desc(F.round("tells", 12)), "gram").limit(most)
    features = sorted(r.gram for r in best.collect())
    found = picked.select("domain", "teaches", counts(F.col("text"), features).alias("c"))
    rows = found.where("teaches").groupBy("domain").agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(features))]).collect()
    logs = {}
    for r in rows:
        c = [r[f"c{i}"] + 1.0 for i in range(len(features))]
        logs[r.domain] = [math.log(x / sum(c)) for x in c]
    means = [sum(x) / len(logs) for x in zip(*logs.values(), strict=True)]
    mix = Mix(features, domains, [[x - m for x, m in zip(logs[d], means, strict=True)] for d in domains], priors)
    place = {d: i for i, d in enumerate(domains)}
    judged = found.where("not teaches").select("domain", F.array(*mix.evidence(F.col("c"))).alias("e")).collect()  # sample_all rows at most
    if judged and len(domains) > 1:
        mix.scale = _scale([(place[r.domain], list(r.e)) for r in judged], priors)
    return mix


def _priors(known: DataFrame, domains: list) -> list[float]:
    """Shares of the domains among all labelled rows."""
    count = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(count[d] for d in domains)
    return [count[d] / total for d in domains]


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict | None = None, temperature: float = 0.7, total: float | None = None, floor: float = 0.0, most: int = FEATURES, sample: int = SAMPLE, sample_all: int = SAMPLE_ALL) -> tuple[Mix, DataFrame]:
    """The fitted mix, and (id, n, __p0, __p1, ..., rate) of every row.

    targets: a weight for each domain (those left out get none); without it, weights are as the domains' present tokens
    to the power of temperature. total: tokens wanted in all; without it as many as there are, or with a floor above zero
    so many that no domain shrinks. Null and empty texts have no tokens and the prior as posterior; their rate follows
    their posterior and changes nothing. Rows that repeat count as often as they are there. Targets that no rates meet, as
    posteriors are soft and rates not negative, are missed by as little as least squares can; a miss is a warning.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    mix = learn(texts, labelled, most, sample, sample_all)
    mix.floor = floor
    k = len(mix.domains)
    names = _columns(k)
    seen = materialise(texts.select("id", tokens(F.col("text")).alias("n"), counts(F.col("text"), mix.features).cast("array<double>").alias("seen")), "mix-counts")
    rows = with_posteriors(seen, mix, "seen").select("id", "n", *names)
    rows = materialise(rows, "mix-posteriors")
    first = rows.agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in names]).first()
    mix.totals = [first[c] or 0.0 for c in names]
    all_ = sum(mix.totals)
    if not all_:
        mix.targets = mix.reached = mix.steps = [0.0] * k
        return mix, rows.withColumn("rate", mix.rate([F.col(c) for c in names]))
    weight = [float(targets.get(d, 0.0)) for d in mix.domains] if targets else [t**temperature for t in mix.totals]
    if min(weight) < 0 or not sum(weight):
        raise ValueError("targets are weights of which one at least is positive")
    weight = [w / sum(weight) for w in weight]
    if total is None:
        total = max(t / w for t, w in zip(mix.totals, weight, strict=True) if w) if floor > 0 else all_
    mix.targets = [w * total for w in weight]
    # misses are relative to the target (to the present tokens, if nothing is wanted), so that domains count alike
    scale = [b if b > 0 else max(t, 1.0) for b, t in zip(mix.targets, mix.totals, strict=True)]
    mix.steps, mix.reached = _descend(rows, names, np.array(mix.targets), np.array(scale), all_, floor)
    missed = {d: a / b for d, a, b, s in zip(mix.domains, mix.reached, mix.targets, scale, strict=True) if abs(a - b) > MISS * s and b}
    if missed:
        warnings.warn(f"no rates meet all targets; the nearest mix has these shares of them: {missed}", stacklevel=2)
    return mix, rows.withColumn("rate", mix.rate([F.col(c) for c in names]))


def _descend(rows: DataFrame, names: list[str], targets: np.ndarray, scale: np.ndarray, tokens_: float, floor: float) -> tuple[list[float], list[float]]:
    """The sum of all steps, and the tokens reached, at the least sum of squared relative misses plus hold times the mean
    squared change of rates.

    At the optimum the steps are the misses times 1 / hold, which is what the gradient here measures. Steps are scaled by the
    matrix of the rates that are above the floor, halved until the dual objective grows, and taken until the gradient is
    zero. A fit that does not end raises.
    """
    k = len(names)
    p = [F.col(c) for c in names]

    def at(y: np.ndarray, hold: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Objective, gradient, matrix and tokens for the multipliers y."""
        move = sum((c * F.lit(float(x)) for c, x in zip(p, y * tokens_ / hold / scale, strict=True)), F.lit(0.0))
        r = rows.select("n", *names, F.greatest(F.lit(float(floor)), 1 - move).alias("r"), (1 - move > floor).cast("int").alias("free"))
        sums = [F.sum(F.col("n") * F.col("r") * c).alias(f"t{i}") for i, c in enumerate(p)]
        sums += [F.sum(F.col("n") * F.col("free") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        got = r.agg(F.sum(F.col("n") * (F.col("r") - 1) ** 2).alias("change"), *sums).first()
        reached = np.array([got[f"t{i}"] for i in range(k)])
        matrix = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / np.outer(scale, scale)
        miss = (reached - targets) / scale
        return float(y @ miss + hold / 2 / tokens_ * got["change"] - y @ y / 2), miss - y, matrix, reached

    y = np.zeros(k)
    for n, hold in enumerate(HOLDS):
        if n:  # begin with the steps that the last ones ended with
            y = y * hold / HOLDS[n - 1]
        value, gradient, matrix, reached = at(y, hold)
        for _ in range(STEPS):
            if np.abs(gradient).max() <= ENDED:
                break
            step, size = np.linalg.solve(np.eye(k) + tokens_ / hold * matrix, gradient), 1.0
            while True:
                tried = at(y + size * step, hold)
                if tried[0] >= value + 1e-4 * size * float(gradient @ step) - 1e-13 * max(1.0, abs(value)) or size < 1e-6:
                    break
                size /= 2
            y = y + size * step
            value, gradient, matrix, reached = tried
        else:
            raise RuntimeError(f"the fit of the mix has not ended after {STEPS} steps: its gradient is {gradient.tolist()}")
    return (y * tokens_ / HOLDS[-1] / scale).tolist(), reached.tolist()


def rates(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_tokens, domain, posterior, rate) of every row: its likeliest domain, and how often it is to be read."""
    mix, rows = fit(docs, labelled, id_col, text_col, **options)
    names = _columns(len(mix.domains))
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    domain = F.coalesce(*[F.when(F.col(c) == best, F.lit(d)) for c, d in zip(names, mix.domains, strict=True)])
    return rows.select("id", F.col("n").alias("n_tokens"), domain.cast("string").alias("domain"), best.alias("posterior"), "rate")


def mixed(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, **options) -> DataFrame:
    """docs with each row as often as its rate says: the whole part, and once more with the rest as probability, which a
    hash of the identifier and the text decides: rows with a null identifier are rounded each by its text, and only rows that
    repeat both are all rounded alike, on any cluster. Text and the other columns do not move between machines."""
    mix, _ = fit(docs, labelled, id_col, text_col, **options)
    row = F.struct(*[F.col(c) for c in docs.columns], F.lit(0).alias("__"))
    rows = docs.select(row.alias("row"), counts(F.col(text_col), mix.features).cast("array<double>").alias("seen"))
    rows = with_posteriors(rows, mix, "seen").withColumn("rate", mix.rate([F.col(c) for c in _columns(len(mix.domains))]))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("row").getField(id_col).cast("string"), F.col("row").getField(text_col)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    rows = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
