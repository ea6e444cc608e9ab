"""Soft-membership mixing: classifier posteriors over domains, and document rates that meet target token shares."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.text import let
from loomframe.llm.common import is_learnable, materialize, release, table, text_or_empty

# Domains over the labels table, the first condition that holds counts; and the shares of tokens to reach.
DOMAINS = {"toxic": "toxic = 1", "low": "quality = 0", "good": "quality = 1"}
WEIGHTS = {"toxic": 0.02, "low": 0.08, "good": 0.90}
N_STATS = 5
PROFILE_BINS = 4096
# Private columns, so that those of users stay.
EVERY, WORDS, STATS, TOKENS, DICE, RATE, COPIES, GAP, P = (
    f"__loomframe_{x}" for x in ("every", "words", "stats", "tokens", "dice", "rate", "copies", "gap", "p")
)


@dataclass
class DomainModel:
    """Multinomial logistic regression over text statistics and the presence of words."""

    domains: list[str]
    biases: list[float]
    stat_weights: list[list[float]]  # by domain, by statistic
    vocabulary: list[str]
    word_weights: list[list[float]]  # by domain, by word

    def posteriors(self, words: Column, stats: Column) -> Column:
        """array<double>, a probability for each domain; the words are looked up once for all of them."""

        def logits(x: Column) -> Column:
            each = zip(self.biases, self.stat_weights, self.word_weights)
            return F.array(*[_dot(x["stats"], sw) + _summed(x["held"], bias, _literal(ww, "array<double>")) if ww else _dot(x["stats"], sw) + F.lit(bias) for bias, sw, ww in each])

        def shares(odds: Column) -> Column:
            return let(F.aggregate(odds, F.lit(0.0), lambda a, o: a + o), lambda total: F.transform(odds, lambda o: o / total))

        def softmax(x: Column) -> Column:
            return let(let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))), shares)

        given = F.struct(held_words(words, self.vocabulary).alias("held"), stats.alias("stats"))
        return let(let(given, logits), softmax)


def _dot(stats: Column, weights: list[float]) -> Column:
    return reduce(Column.__add__, [F.get(stats, F.lit(j)) * F.lit(w) for j, w in enumerate(weights)])


def _literal(values: list, kind: str) -> Column:
    """A long array as one literal instead of one for each of its elements."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def held_words(words: Column, vocabulary: list[str]) -> Column:
    """The numbers, from 1, of the vocabulary's words among ``words``: looked up in a literal hash table, so its size costs nothing."""
    if not vocabulary:
        return F.array().cast("array<int>")
    n = 1 << max(4, (2 * len(vocabulary)).bit_length())
    table: list[list[int]] = [[] for _ in range(n)]
    for i, w in enumerate(vocabulary):
        table[xxhash.xxh64_intdigest(w.encode(), 42) % n].append(i + 1)
    rows, spelled = _literal(table, "array<array<int>>"), _literal(vocabulary, "array<string>")
    taken = F.lit("".join("1" if row else "0" for row in table)).cast("binary")
    bucket = lambda w: F.xxhash64(w).bitwiseAND(F.lit(n - 1)).cast("int")
    likely = F.filter(words, lambda w: F.substring(taken, bucket(w) + 1, F.lit(1)) == F.lit(b"1"))
    return F.flatten(F.transform(likely, lambda w: F.filter(F.get(rows, bucket(w)), lambda i: F.element_at(spelled, i) == w)))


def _summed(held: Column, start: float, gain: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        return acc + F.element_at(gain, i)

    return F.aggregate(held, F.lit(start), add)


def described(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus WORDS (distinct lower-cased runs of letters and digits), STATS (array of N_STATS numbers) and TOKENS (how many words)."""
    text = text_or_empty(F.col(text_col))
    pieces = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = docs.withColumn(EVERY, pieces).withColumn(WORDS, F.array_distinct(EVERY))
    n, distinct = F.size(EVERY), F.size(WORDS)
    at_least_one = F.greatest(n, F.lit(1))
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]"))
    stats = [F.log2(n + 1), F.log2(distinct + 1), distinct / at_least_one, F.length(text) / at_least_one, marks / at_least_one]
    return split.withColumns({STATS: F.array(*stats), TOKENS: n.cast("long")}).drop(EVERY)


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    domains: dict[str, str],
    id_col: str,
    text_col: str,
    max_train_rows: int = 6000,
    evidence: float = 15.0,
) -> DomainModel | None:
    """Fit on about ``max_train_rows`` learnable labelled rows, chosen by a hash of their ids; None without any.

    The vocabulary is every word of those rows whose presence goes with the domain by a likelihood ratio (G) of at least
    ``evidence``, however many they are. Several labels of an id all count.
    """
    case = F.lit(None).cast("string")
    for name, condition in reversed(domains.items()):
        case = F.when(F.expr(condition), F.lit(name)).otherwise(case)
    marks = labels.select(F.col(id_col).alias("id"), case.alias("domain")).where(is_learnable(F.col("id")) & F.col("domain").isNotNull()).distinct()
    share = max_train_rows / max(1, marks.count())
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    train = materialize(described(rows, "text").select("domain", WORDS, STATS), "mixing-train")
    sizes = {r["domain"]: r["count"] for r in train.groupBy("domain").count().collect()}
    names = [d for d in domains if d in sizes]
    if len(names) < 2:
        release(train)
        return DomainModel(names, [0.0], [[0.0] * N_STATS], [], [[]]) if names else None
    n = sum(sizes.values())
    with_word = [F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(names)]
    words = train.select("domain", F.explode(WORDS).alias("word")).groupBy("word").agg(*with_word)
    all_of = reduce(Column.__add__, [F.col(f"n{k}") for k in range(len(names))])
    ratio = F.lit(0.0)
    for k, d in enumerate(names):
        for part, whole in ((F.col(f"n{k}"), all_of), (F.lit(sizes[d]) - F.col(f"n{k}"), F.lit(n) - all_of)):
            ratio = ratio + F.when(part > 0, 2.0 * part * F.log(part * F.lit(float(n)) / (whole * F.lit(sizes[d])))).otherwise(0.0)
    vocabulary = [r["word"] for r in words.where(ratio >= evidence).orderBy("word").select("word").collect()]
    number = F.lit(0)
    for k, d in enumerate(names):
        number = F.when(F.col("domain") == d, F.lit(k)).otherwise(number)
    present = F.array().cast("array<double>")
    if vocabulary:
        present = let(
            held_words(F.col(WORDS), vocabulary),
            lambda held: F.transform(F.sequence(F.lit(1), F.lit(len(vocabulary))), lambda j: F.array_contains(held, j).cast("double")),
        )
    features = array_to_vector(F.concat(F.col(STATS), present)).alias("features")
    rows = materialize(train.select(number.cast("double").alias("y"), features), "mixing-features")
    fit = LogisticRegression(labelCol="y", family="multinomial", regParam=1e-3, maxIter=80).fit(rows)
    weights = fit.coefficientMatrix.toArray()
    release(train, rows)
    return DomainModel(
        names, [float(x) for x in fit.interceptVector], weights[:, :N_STATS].tolist(), vocabulary, weights[:, N_STATS:].tolist()
    )


def rate_expr(posteriors: list[Column], moved: list[float], most: float | None = None) -> Column:
    """The rate after moving by so much along each domain's gradient, from 1, projected to 0 or more (and to ``most``, if that is asked for)."""
    rate = F.lit(1.0) - reduce(Column.__add__, [p * F.lit(float(c)) for p, c in zip(posteriors, moved)], F.lit(0.0))
    return F.greatest(F.lit(0.0), rate if most is None else F.least(F.lit(float(most)), rate))


def fit_rates(
    profile: DataFrame, n_domains: int, goals: list[float], tolerance: float = 1e-4, max_steps: int = 40, most: float | None = None, ridge: float = 1e-6
) -> tuple[list[float], float]:
    """How far to move along each domain's gradient, so that the expected domain tokens are nearest ``goals`` (tokens) in least squares, and the gap left.

    profile: ``(p0.., tokens)``, the token mass of each posterior. The gradient of a document's rate is its posteriors times
    how far each domain is off, so the steps of a document add up to its posteriors times one vector, the same for all, and
    the projection is applied to their sum (projected gradient with lazy projection). A rate is then a column
    expression of the posteriors, however many steps there were. Each step costs one pass over the profile, which sums a
    number for each domain and pair of domains, and is scaled by the inverse Gram matrix of the posteriors of documents whose
    rate is inside its bounds; one that goes too far is quartered. ``ridge`` weighs the distance of rates from 1 against that
    of the domains: where goals are out of reach, it keeps rates finite.

    The gap is the largest distance of a domain from its goal as a share of all tokens: above ``tolerance`` the goals
    cannot be met by rates that are not negative (nor above ``most``), or not in ``max_steps``. Without tokens there are no
    steps and no gap.
    """
    ps = [F.col(f"p{k}") for k in range(n_domains)]
    pairs = [(i, j) for i in range(n_domains) for j in range(i, n_domains)]
    total = float(profile.agg(F.sum("tokens")).first()[0] or 0)
    moved, step, lowest, gap = np.zeros(n_domains), np.zeros(n_domains), float("inf"), 0.0
    goal = np.array(goals) / total if total else np.zeros(n_domains)
    for _ in range(max_steps if total else 0):
        tried = moved + step
        mass, reach = F.col("tokens") / total, F.lit(1.0) - reduce(Column.__add__, [p * F.lit(float(c)) for p, c in zip(ps, tried)])
        rated = profile.withColumns({"rate": rate_expr(ps, tried.tolist(), most), "mass": mass, "reach": reach})
        live = F.col("rate") == F.col("reach")
        got = rated.agg(
            F.sum(F.col("mass") * F.col("rate") * (F.col("reach") - F.col("rate") / 2)),
            *[F.sum(p * F.col("mass") * F.col("rate")) for p in ps], *[F.sum(F.when(live, ps[i] * ps[j] * F.col("mass")).otherwise(0.0)) for i, j in pairs],
        ).first()
        height = got[0] + float(goal @ tried) + ridge / 2 * float(tried @ tried)  # of the convex function that the steps go down
        if height > lowest + 1e-15:
            step = step / 4
            continue
        moved, lowest = tried, height
        missed = np.array(got[1 : 1 + n_domains]) - goal
        gap, slope = float(np.abs(missed).max()), missed - ridge * moved
        if gap <= tolerance or float(np.abs(slope).max()) <= 1e-3 * tolerance:
            break
        gram = ridge * np.eye(n_domains)
        for value, (i, j) in zip(got[1 + n_domains :], pairs):
            gram[i, j] = gram[j, i] = value + (ridge if i == j else 0.0)
        step = np.linalg.solve(gram, slope)
    return moved.tolist(), gap


def _rated(
    docs: DataFrame, labels: DataFrame, domains: dict[str, str], weights: dict[str, float], full: str | None, most: float | None, max_steps: int,
    id_col: str, text_col: str, keep_text: bool,
) -> DataFrame:
    """``docs`` with TOKENS, RATE, COPIES, GAP and a posterior P + domain for each domain, all under private names."""
    model = fit_domains(docs, labels, domains, id_col, text_col)
    spread = described(docs, text_col)
    names = model.domains if model else []
    kept = [c for c in docs.columns if keep_text or c != text_col]
    dice = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_or_empty(F.col(text_col))), F.lit(1 << 30)) / float(1 << 30)
    given = spread.withColumn(P, model.posteriors(F.col(WORDS), F.col(STATS))) if model else spread
    scored = materialize(given.select(*kept, TOKENS, dice.alias(DICE), *[F.col(P)[k].alias(f"{P}{k}") for k in range(len(names))]), "mixing-scored")
    own = [F.col(f"{P}{k}") for k in range(len(names))]
    moved, gap = [0.0] * len(names), 0.0
    if names:
        # Posteriors that agree to 1/PROFILE_BINS are one row of the profile, at the mean of their tokens' posteriors.
        mass = F.sum(TOKENS)
        means = [F.coalesce(F.sum(p * F.col(TOKENS)) / F.nullif(mass, F.lit(0)), F.avg(p)).alias(f"p{k}") for k, p in enumerate(own)]
        cells = [F.floor(p * PROFILE_BINS).alias(f"cell{k}") for k, p in enumerate(own)]
        profile = materialize(scored.groupBy(*cells).agg(mass.alias("tokens"), *means), "mixing-profile")
        have = profile.agg(*[F.coalesce(F.sum(F.col(f"p{k}") * F.col("tokens")), F.lit(0.0)) for k in range(len(names))]).first()
        shares = [weights[d] / (sum(weights[d] for d in names) or 1.0) for d in names]
        if full in names and shares[names.index(full)] > 0:
            total = have[names.index(full)] / shares[names.index(full)]
        else:
            total = min([h / w for h, w in zip(have, shares) if w > 0], default=0.0)
        moved, _ = fit_rates(profile, len(names), [total * w for w in shares], max_steps=max_steps, most=most)
        mass = F.col("tokens") * rate_expr([F.col(f"p{k}") for k in range(len(names))], moved, most)
        got = profile.agg(*[F.coalesce(F.sum(F.col(f"p{k}") * mass), F.lit(0.0)) for k in range(len(names))]).first()
        gap = max(abs(g / sum(got) - w) for g, w in zip(got, shares)) if sum(got) > 0 else 0.0
        release(profile)
    rated = scored.withColumns({RATE: rate_expr(own, moved, most), GAP: F.lit(float(gap))})
    rated = rated.withColumn(COPIES, F.floor(F.col(RATE) + F.col(DICE)).cast("int"))
    posterior = [(own[names.index(d)] if d in names else F.lit(0.0)).alias(f"{P}_{d}") for d in domains]
    return rated.select(*kept, TOKENS, RATE, COPIES, GAP, *posterior)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domains: dict[str, str] | None = None,
    weights: dict[str, float] | None = None,
    full: str | None = "good",
    most: float | None = None,
    max_steps: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` plus ``tokens``, ``p_<domain>``, ``rate``, ``copies`` and ``gap``.

    The expected tokens of each domain, posterior times tokens times rate, are brought to the weights' shares of a total:
    that at which domain ``full`` keeps the tokens that it has, or, if ``full`` is None or has no share, the largest at
    which no domain needs more tokens than it has. Rates are not negative, and not above ``most`` if that is given.
    ``copies`` rounds the rate up or down by a hash of the id and text, so that its mean is the rate. ``gap``, the same in all rows, is
    the largest distance of a domain's share of the mixed tokens from its weight: near 0, or the weights cannot be met.
    Null and empty texts have no tokens and rates by their posterior. Without labels
    every rate is 1. A domain that no label names has no posterior, and the others share its weight.
    Only column expressions run here. Columns of the added names are replaced.
    """
    domains, weights = domains or DOMAINS, weights or WEIGHTS
    rest = docs.drop("tokens", "rate", "copies", "gap", *[f"p_{d}" for d in domains])
    rated = _rated(rest, labels, domains, weights, full, most, max_steps, id_col, text_col, keep_text)
    kept = [c for c in rest.columns if keep_text or c != text_col]
    given = [F.col(f"{P}_{d}").alias(f"p_{d}") for d in domains]
    return rated.select(
        *kept, F.col(TOKENS).alias("tokens"), *given, F.col(RATE).alias("rate"), F.col(COPIES).alias("copies"), F.col(GAP).alias("gap")
    )


def mixed_documents(
    docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None, weights: dict[str, float] | None = None,
    full: str | None = "good", most: float | None = None, max_steps: int = 40, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with every row repeated ``copies`` times (see ``mix``), so that expected domain shares are the weights; all columns stay as they are."""
    rated = _rated(docs, labels, domains or DOMAINS, weights or WEIGHTS, full, most, max_steps, id_col, text_col, True)
    repeated = rated.where(F.col(COPIES) > 0).withColumn(DICE, F.explode(F.sequence(F.lit(1), F.col(COPIES))))
    return repeated.select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, table(spark, sf_dir, "labels"), keep_text=False)
