"""Mixing documents to target weights of domains with soft membership, in DataFrame functions only.

A classifier learned from the labelled table gives each document a posterior over domains. The
expected tokens of a domain are the documents' rates times tokens times posteriors, summed; projected
gradient steps of a least-squares fit move the rates, never below 0, until these totals match the
targets. All sums are over all documents, a few numbers each; the rates are columns.

Classifier: naive Bayes over signs that a text has or lacks. The signs are shares of kinds of
characters in steps, and the presence of words that are telling: of the labelled rows, a bounded
sample chosen by seeded hash of doc_id shows which words are much more likely in one domain than in
the others. The counts per domain of a sign's values are learned from all labelled rows.

Fit: rates r of 0 and more minimise the squared distance between expected and target totals, in the
metric of the inverse Gram matrix of all posteriors, from r = 1. A gradient step changes all rates by a
linear function of the posterior, and is projected to rates of 0 and more; without cuts one step is
exact. With cuts, a longer step in the metric of the documents that aren't cut is tried first, and the
plain step where that doesn't bring the totals nearer. Steps end when no total is off by more than
`close`, when none leads nearer (the least-squares optimum) or after `rounds` of them; if the targets
aren't met then, as those that no rates can meet never are, a warning gives the totals, and the rates
are those of the nearest totals found.

Cases: null text has no tokens and posteriors from its signs; null labels and labels of unknown ids
are not learned from; an id with several labels counts with each. A domain that no document belongs
to can't be met, and is left out; where that is the first, targets are relative to all tokens. Texts
are read whole at any length. Words that tell equally come by their letters. Null doc_ids and repeated
rows are rows as any others; rows that agree in doc_id and text are rounded alike. An empty table gives
none. Other columns are kept by `mixed`, clashing names raise ValueError; `mix` ignores them.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import drop, let, materialise

#: Domains by their labels: (quality, toxic) of the labelled table.
DOMAINS = ("clean", "low", "toxic")


@dataclass(frozen=True)
class Params:
    #: Tokens of each domain wanted, relative to the first domain's tokens as they are.
    targets: tuple[float, ...] = (1.1, 0.06, 0.02)
    sample: int = 4000  # labelled rows from which telling words are chosen
    words: int = 60  # telling words of each domain at most
    seed: int = 23
    rounds: int = 40  # steps at most
    close: float = 1e-4  # how far a total may be off, as a share of the largest target
    enough: float = 0.7  # a step that leaves less than this of the distance is taken without trying a shorter one


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).when(quality == 1, F.lit(0))


def _words(text: Column) -> Column:
    """Runs of letters in lower case; an empty one may come at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def _level(value: Column, steps: tuple[float, ...]) -> Column:
    """0 below the first step, 1 from there on, and so on."""
    return F.size(F.filter(F.lit(list(steps)), lambda s: s <= value))


#: Measures and the steps that make signs of them.
STEPS = {"capitals": (0.01, 0.1, 0.4), "marks": (0.005, 0.03, 0.1), "long": (4.0, 7.0, 10.0), "size": (100.0, 1000.0, 10000.0)}


def signs(documents: DataFrame, telling: list[str]) -> DataFrame:
    """documents with n_tokens, a level for each of STEPS, and `hits` (its telling words)."""
    text = F.coalesce("text", F.lit(""))
    df = documents.withColumn("_w", _words(F.col("text")))
    size = F.greatest(F.length(text), F.lit(1))
    df = df.withColumn("n_tokens", (F.size("_w") - (F.element_at("_w", 1) == "").cast("int") - ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")).cast("long"))
    values = {
        "capitals": F.regexp_count(text, F.lit("[A-Z]")) / size,
        "marks": F.regexp_count(text, F.lit("[#*$%&|<>!]")) / size,
        "long": F.length(text) / F.greatest("n_tokens", F.lit(1)),
        "size": F.length(text).cast("double"),
    }
    hits = F.array_intersect("_w", F.array(*[F.lit(w) for w in telling]).cast("array<string>")) if telling else F.array().cast("array<string>")
    return df.select(*documents.columns, "n_tokens", *[_level(values[k], steps).alias(k) for k, steps in STEPS.items()], hits.alias("hits"))


def _summed(keys: str, values: Column) -> Column:
    """Sum of a map's values at the keys of an array column."""
    return F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + values[k])


@dataclass
class Classifier:
    telling: list[str]
    prior: np.ndarray  # log share of each domain
    levels: dict[str, np.ndarray]  # measure -> levels x domains, log chances
    words: np.ndarray  # telling words x domains, log odds of having the word against lacking it

    def posterior(self) -> Column:
        """array<double> over DOMAINS from the columns of `signs`."""
        logs = []
        for k in range(len(DOMAINS)):
            total = F.lit(float(self.prior[k]))
            for name, table in self.levels.items():
                total = total + F.element_at(F.lit([float(x) for x in table[:, k]]), F.col(name) + 1)
            if self.telling:
                odds = F.create_map(*[x for w, v in zip(self.telling, self.words[:, k], strict=True) for x in (F.lit(w), F.lit(float(v)))])
                total = total + _summed("hits", odds)
            logs.append(total)
        scaled = let(F.array(*logs), lambda r: F.transform(r, lambda x: F.exp(x - F.array_max(r))))
        return let(scaled, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def telling_words(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> list[str]:
    """Words much more likely in one domain than in the rest, from the sample of labelled rows."""
    known = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("d")).filter("doc_id IS NOT NULL AND d IS NOT NULL")
    chosen = known.orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id", "d").limit(p.sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # p.sample rows at most
    each = rows.select("doc_id", "d", F.explode(F.array_distinct(_words(F.col("text")))).alias("w")).filter("w <> ''")
    counts = each.groupBy("w").agg(*[F.sum((F.col("d") == k).cast("long")).alias(f"n{k}") for k in range(len(DOMAINS))])
    counts = materialise(counts.filter(sum(F.col(f"n{k}") for k in range(len(DOMAINS))) >= 5), "words")
    size = {r.d: r["count"] for r in chosen.groupBy("d").count().collect()}
    out: list[str] = []
    for k in range(len(DOMAINS)):
        n, rest = size.get(k, 0), sum(v for d, v in size.items() if d != k)
        if not n or not rest:
            continue
        others = sum(F.col(f"n{j}") for j in range(len(DOMAINS)) if j != k)
        odds = F.log((F.col(f"n{k}") + 0.5) / (n + 1)) - F.log((others + 0.5) / (rest + 1))
        best = counts.filter(F.col(f"n{k}") >= max(5, 0.02 * n)).select("w", odds.alias("o")).filter("o > 2").orderBy(F.desc("o"), "w").limit(p.words)
        out += [r.w for r in best.collect() if r.w not in out]
    return out


def learn(signed: DataFrame, labels: DataFrame, telling: list[str]) -> Classifier:
    """signed (doc_id and the columns of `signs`), labels (doc_id, quality, toxic) -> a classifier from all labelled rows."""
    known = labels.select(F.col("doc_id").alias("_id"), domain(F.col("quality"), F.col("toxic")).alias("d")).filter("_id IS NOT NULL AND d IS NOT NULL")
    rows = signed.select("doc_id", *STEPS, "hits").join(known, F.col("doc_id") == F.col("_id"))
    pairs = F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("level")), *[F.struct(F.lit(k).alias("name"), F.col(k).alias("level")) for k in STEPS])
    both = F.concat(pairs, F.transform("hits", lambda w: F.struct(F.concat(F.lit("="), w).alias("name"), F.lit(0).alias("level"))))
    counts = rows.select("d", F.inline(both)).groupBy("d", "name", "level").count().collect()  # domains x signs
    n = np.zeros(len(DOMAINS))
    levels = {k: np.zeros((len(s) + 1, len(DOMAINS))) for k, s in STEPS.items()}
    words = np.zeros((len(telling), len(DOMAINS)))
    place = {w: i for i, w in enumerate(telling)}
    for r in counts:
        if not r["name"]:
            n[r.d] += r["count"]
        elif r["name"][0] == "=":
            words[place[r["name"][1:]], r.d] += r["count"]
        else:
            levels[r["name"]][r.level, r.d] += r["count"]
    chance = (words + 0.5) / (n + 1)
    absent = np.log1p(-chance).sum(0) if len(telling) else np.zeros(len(DOMAINS))
    logs = {k: np.log((t + 1) / (n + len(t))) for k, t in levels.items()}
    return Classifier(telling, np.log((n + 1) / (n.sum() + len(DOMAINS))) + absent, logs, np.log(chance) - np.log1p(-chance))


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate after projected gradient steps, each a linear function of the posterior."""
    def moved(post: Column) -> Column:
        rate = F.lit(1.0)
        for g in steps:
            rate = F.greatest(F.lit(0.0), rate - sum(F.element_at(post, k + 1) * float(v) for k, v in enumerate(g)))
        return rate

    return let(F.col("post"), moved)


@dataclass
class Fit:
    steps: list[np.ndarray]  # that make the rates
    totals: np.ndarray  # expected at these rates
    target: np.ndarray
    met: bool


def fit(weights: DataFrame, p: Params = Params()) -> Fit:
    """weights (n_tokens, post) -> the gradient steps whose rates meet the targets, or come as near as `rounds` steps get; a warning says where they don't meet them."""
    k = len(DOMAINS)
    post = [F.element_at("post", i + 1) for i in range(k)]
    tokens = F.col("n_tokens").cast("double")

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected totals at the steps' rates, and the Gram matrix of posteriors where the rate isn't 0."""
        rated = weights.select("n_tokens", "post", _rate(steps).alias("rate"))
        free = tokens * (F.col("rate") > 0).cast("double")
        row = rated.agg(*[F.sum(tokens * F.col("rate") * a) for a in post], *[F.sum(free * a * b) for a in post for b in post]).first()
        got = np.array([x or 0.0 for x in row])
        return got[:k], got[k:].reshape(k, k)

    totals, gram = sums([])
    there = totals > 0
    if not there.any():
        return Fit([], totals, totals, True)
    target = np.where(there, np.array(p.targets) * (totals[0] or totals.sum()), 0.0)
    # In this metric the gradient of the distance changes no faster than the rates do, so a step of 1 never leads away.
    metric = np.linalg.pinv(gram, rcond=1e-12)

    def distance(totals: np.ndarray) -> tuple[np.ndarray, float]:
        off = np.where(there, totals - target, 0.0)
        return off, float(off @ metric @ off)

    def met() -> bool:
        return np.abs(off).max() <= p.close * target.max()

    (off, far), steps = distance(totals), []
    for _ in range(p.rounds):
        if met():
            break
        best = None
        # In the scale of the rates that aren't cut, a step is longer; where cuts make it too long, the plain one holds.
        for step in (np.linalg.pinv(gram, rcond=1e-12) @ off, metric @ off):
            tried = sums([*steps, step])
            to = distance(tried[0])[1]
            if best is None or to < best[0]:
                best = to, step, tried
            if to <= p.enough * far:
                break
        if best[0] >= far * (1 - 1e-9):
            break  # a least-squares optimum, as far as sums can tell
        steps.append(best[1])
        totals, gram = best[2]
        off, far = distance(totals)
    if not met():
        warnings.warn("targets not met: " + ", ".join(f"{n} {t:.6g} of {w:.6g} tokens" for n, t, w in zip(DOMAINS, totals, target, strict=True)), stacklevel=2)
    return Fit(steps, totals, target, met())


def plan(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[Classifier, list[np.ndarray], DataFrame]:
    """The classifier, the fitted steps, and the table (doc_id, draw, n_tokens, post) of all documents."""
    telling = telling_words(documents, labels, p)
    signed = materialise(signs(documents.select("doc_id", "text"), telling).withColumn("draw", _draw(p.seed)).drop("text"), "signs")
    model = learn(signed, labels, telling)
    weights = materialise(signed.select("doc_id", "draw", "n_tokens", model.posterior().alias("post")), "posteriors")
    drop(signed)
    return model, fit(weights, p).steps, weights


def _draw(seed: int) -> Column:
    """A number from 0 to 1 by a hash of the doc_id and the text, which decides how a row's rate is rounded."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)


def _copies(draw: Column) -> Column:
    """The rate rounded up or down by chance, so that its mean is the rate."""
    return F.floor(F.col("rate") + draw).cast("int")


def mix(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, quality, toxic) -> doc_id, n_tokens, p_ of each domain, rate, copies."""
    _, steps, weights = plan(documents, labels, p)
    out = weights.withColumn("rate", _rate(steps))
    return out.select("doc_id", "n_tokens", *[F.element_at("post", k + 1).alias(f"p_{name}") for k, name in enumerate(DOMAINS)], "rate", _copies(F.col("draw")).alias("copies"))


def mixed(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Each of the documents as often as `copies` says, with all its columns."""
    clash = {"n_tokens", "post", "rate", "copies", "hits", "_w", "draw", *STEPS} & set(documents.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are already there")
    model, steps, _ = plan(documents, labels, p)
    rated = signs(documents, model.telling).withColumn("post", model.posterior()).withColumn("rate", _rate(steps))
    times = materialise(rated.withColumn("copies", _copies(_draw(p.seed))).select(*documents.columns, "copies"), "rated").filter("copies > 0")
    return times.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*documents.columns)
