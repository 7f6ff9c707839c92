"""Soft-membership mixing: domain posteriors from labelled rows, and document rates that meet domain token targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import numbered
from plumbline.workspace import store

#: Domains, in the order of the posteriors: by the labels `toxic` and `quality`.
DOMAINS = ("good", "poor", "toxic")
#: Labelled rows the classifier is fitted on at most (those of the least hash).
MOST_LABELLED = 200_000
#: Words are hashed into 2**HASH_BITS features; those that tell a domain from the others by LEAST_Z standard errors, and are
#: found in LEAST_DOCUMENTS labelled documents of it, count, the FEATURES best at most.
HASH_BITS, LEAST_Z, LEAST_DOCUMENTS, FEATURES = 18, 4.0, 3, 512
#: Bounds of the bins of a document's measures: signs, letters a word, words, and the evidence for poor and for toxic.
BINS = ((0.02, 0.04, 0.08, 0.16), (3, 4, 5, 7), (20, 100), (0.0, 2.0, 5.0), (0.0, 1.5, 3.0, 5.0, 8.0))


#: Steps of this part of 1 spread evenly over [0, 1).
GOLDEN = 0.6180339887498949


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << HASH_BITS)).cast("int"))


def _domain() -> Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)


def word_weights(labelled: DataFrame, most: int = FEATURES) -> list[tuple[int, float, float]]:
    """(hashed word, weight for poor, weight for toxic): the log odds of a word in documents of the domain against the
    others, zero where they are not significant. `labelled` has text and domain."""
    held = labelled.select("domain", F.explode(F.array_distinct(_hashed(_words(F.col("text"))))).alias("h"))
    is_in = lambda d: F.sum((F.col("domain") == d).cast("long"))
    n = labelled.agg(F.count(F.lit(1)), is_in(1), is_in(2)).first()
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), is_in(1).alias("n1"), is_in(2).alias("n2"))

    def weight(d: int) -> tuple[Column, Column]:
        here, there = F.col(f"n{d}") + 0.5, F.col("n") - F.col(f"n{d}") + 0.5
        inside, outside, share = (n[d] or 0) + 1, n[0] - (n[d] or 0) + 1, F.col("n") / (n[0] + 1)
        odds = F.log(here / inside / (there / outside))
        z = (F.col(f"n{d}") / inside - (F.col("n") - F.col(f"n{d}")) / outside) / F.sqrt(share * (1 - share) * (1 / inside + 1 / outside) + 1e-12)
        return F.when((z > LEAST_Z) & (F.col(f"n{d}") >= LEAST_DOCUMENTS), odds).otherwise(0.0), z

    (poor, z_poor), (toxic, z_toxic) = weight(1), weight(2)
    best = counts.select("h", poor.alias("poor"), toxic.alias("toxic"), F.greatest(z_poor, z_toxic).alias("z")).where("poor > 0 or toxic > 0").orderBy(F.desc("z"), "h").limit(most)
    return [(r["h"], r["poor"], r["toxic"]) for r in best.collect()]


def features(docs: DataFrame, weights: list[tuple[int, float, float]], text: str = "text") -> DataFrame:
    """Add n_tokens (words, at least one) and `f`, the bins of the whole text's measures."""
    chars = F.greatest(F.char_length(F.coalesce(F.col(text), F.lit(""))), F.lit(1))
    words = docs.withColumn("_words", _words(F.col(text)))
    table = lambda i, kind: F.array(*[F.lit(w[i]) for w in weights]).cast(f"array<{kind}>")
    hits = F.array_intersect(_hashed(F.col("_words")), table(0, "int")) if weights else F.array().cast("array<int>")
    counted = words.select("*", chars.alias("_chars"), F.greatest(F.size("_words"), F.lit(1)).alias("_n"), F.char_length(F.array_join("_words", "")).alias("_letters"), hits.alias("_hits"))
    evidence = lambda i: F.aggregate("_hits", F.lit(0.0), lambda a, h: a + F.get(table(i, "double"), (F.array_position(table(0, "int"), h) - 1).cast("int"))) if weights else F.lit(0.0)
    # what is neither a letter nor one sign between two words: runs of signs, digits, bars
    other = (F.col("_chars") - F.col("_letters") - F.col("_n") + 1) / F.col("_chars")
    measured = counted.select("*", other.alias("_x0"), (F.col("_letters") / F.col("_n")).alias("_x1"), F.col("_n").alias("_x2"), evidence(1).alias("_x3"), evidence(2).alias("_x4"))
    f = F.array(*[sum(((F.col(f"_x{i}") > b).cast("int") for b in bounds), F.lit(0)) for i, bounds in enumerate(BINS)])
    return measured.select(*docs.columns, F.col("_n").cast("long").alias("n_tokens"), f.alias("f"))


def posteriors(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens and p (one probability a domain) of every document: naive Bayes over the bins of its measures, two of
    which are the evidence of its hashed words."""
    known = labels.where("toxic is not null and quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    # an even share of the labels by hash, so that no task gathers them
    share = most_labelled / max(known.count(), 1)
    chosen = known if share >= 1 else known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # `chosen` has most_labelled rows of three numbers, about: a bound that lets the texts stay where they are
    labelled = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("text", _domain().alias("domain"))
    labelled = store(labelled, "mix-labelled")
    weights = word_weights(labelled)
    patterns = features(labelled, weights).groupBy("domain", "f").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the combinations of bins
    count: dict[tuple[int, int, int], int] = {}
    for r in patterns:
        for i, v in enumerate(r["f"]):
            count[i, v, r["domain"]] = count.get((i, v, r["domain"]), 0) + r["n"]
    total = {d: sum(r["n"] for r in patterns if r["domain"] == d) for d in range(len(DOMAINS))}

    def score(d: int) -> Column:
        prior = F.log(F.lit((total[d] + 1) / (sum(total.values()) + len(DOMAINS))))
        tables = [F.array(*[F.log(F.lit((count.get((i, v, d), 0) + 0.5) / (total[d] + 0.5 * (len(bounds) + 1)))) for v in range(len(bounds) + 1)]) for i, bounds in enumerate(BINS)]
        return sum((F.element_at(t, F.col("f")[i] + 1) for i, t in enumerate(tables)), prior)

    scored = features(docs.select(key, text), weights, text).select(key, "n_tokens", *[score(d).alias(f"s{d}") for d in range(len(DOMAINS))])
    names = [f"s{d}" for d in range(len(DOMAINS))]
    top = F.greatest(*names)
    mass = [F.exp(F.col(s) - top) for s in names]
    return scored.select(key, "n_tokens", F.array(*[F.round(w / sum(mass[1:], mass[0]), 6) for w in mass]).alias("p"))


def fit_rates(mass: DataFrame, targets: list[float], rounds: int = 40, tolerance: float = 1e-3) -> list[list[float]]:
    """Projected gradient on (p, tokens): the steps taken, from which each rate follows.

    Minimises the squared gaps between the expected tokens of the domains, sum of rate * tokens * p, and their targets,
    each weighted by one over the domain's tokens, over nonnegative rates that begin at 1. With these weights the
    curvature is at most 1, so each step has full length. A document's rate depends only on the steps so far and its own
    p: a round is one aggregation of a few sums, and no rates are kept between rounds. It ends when the targets are met,
    or when a round no longer moves what is met (targets need not be reachable without negative rates).
    """
    p = lambda d: F.col("p")[d]
    natural = mass.agg(*[F.sum(F.col("tokens") * p(d)) for d in range(len(targets))]).first()
    if not sum(filter(None, natural)):
        return []
    steps: list[list[float]] = []
    before: list[float] = []
    for _ in range(rounds):
        met = mass.agg(*[F.sum(rate_of(steps) * F.col("tokens") * p(d)) for d in range(len(targets))]).first()
        gaps = [(m - t) / n if n else 0.0 for m, t, n in zip(met, targets, natural)]
        if max(map(abs, gaps)) < tolerance or before and max(abs(g - b) for g, b in zip(gaps, before)) < tolerance / 10:
            break
        steps.append(gaps)
        before = gaps
    return steps


def rate_of(steps: list[list[float]]) -> Column:
    """The rate of a document with posteriors `p` after these projected steps."""
    if not steps:
        return F.lit(1.0)
    taken = ", ".join(f"array({', '.join(f'{x!r}D' for x in s)})" for s in steps)
    return F.expr(f"aggregate(array({taken}), 1.0D, (r, s) -> greatest(0.0D, r - ({' + '.join(f's[{d}] * p[{d}]' for d in range(len(steps[0])))})))")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, text: str = "text", key: str = "doc_id", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Fit a rate for every document so that the expected tokens of each domain meet its target.

    `weights` gives the target of each domain as a multiple of its expected tokens (default: good and poor as they
    are, toxic none). A target below what documents that are likelier of other domains carry of this one, at their weights,
    could only be met by thinning those, and is raised to that. A row per document: key, n_tokens (words), p_good, p_poor, p_toxic, rate, copies. `copies` is a whole
    number, the floor of rate + u: documents of like posteriors and size are numbered, and u runs over [0, 1) evenly along
    them, so that the copies' tokens meet the targets too. A null or empty text is one token; without labelled rows each
    domain is as likely; a null key is scored but never labelled; repeated rows get a row each; no rows give no rows; of
    labels, rows with a null are left out, and of several for a document the worst label counts; other columns are not read.
    """
    wanted = {"good": 1.0, "poor": 1.0, "toxic": 0.0} | (weights or {})
    scored = store(posteriors(docs, labels, most_labelled, text, key), "mix-posteriors")
    # one row per posterior that occurs: at most one for each combination of feature bins, so one file holds them all
    mass = store(store(scored.groupBy("p").agg(F.sum("n_tokens").alias("tokens")), "mix-mass-parts").coalesce(1), "mix-mass")
    likeliest = F.array_position("p", F.array_max("p")) - 1
    carried = mass.agg(*[F.sum(F.when(likeliest == own, F.col("tokens") * F.col("p")[d])).alias(f"x{own}{d}") for own in range(len(DOMAINS)) for d in range(len(DOMAINS))]).first()
    share = lambda own, d: carried[f"x{own}{d}"] or 0.0
    natural = [sum(share(own, d) for own in range(len(DOMAINS))) for d in range(len(DOMAINS))]
    others = [sum(wanted[name] * share(own, d) for own, name in enumerate(DOMAINS) if own != d) for d in range(len(DOMAINS))]
    targets = [max(wanted[name] * natural[d], others[d]) for d, name in enumerate(DOMAINS)]
    rate = rate_of(fit_rates(mass, targets))
    out = scored.select(key, "n_tokens", *[F.col("p")[d].alias(f"p_{name}") for d, name in enumerate(DOMAINS)], F.round(rate, 6).alias("rate"))
    # strata: posteriors to a quarter, sizes to a fifth of an octave; their number does not follow the documents
    strata = out.withColumn("_like", (F.round(F.col("p_toxic") * 4) * 5 + F.round(F.col("p_poor") * 4)).cast("int")).withColumn("_size", F.floor(5 * F.log2("n_tokens")).cast("int"))
    placed = numbered(store(strata, "mix-strata"), ["_like", "_size"], F.struct(key, "n_tokens", "p_toxic"), "mix")
    turn = F.col("slot") * F.lit(GOLDEN) + F.pmod(F.xxhash64("_like", "_size"), F.lit(1000)) / 1000
    return placed.select(*out.columns, F.floor(F.col("rate") + (turn - F.floor(turn))).cast("int").alias("copies"))
