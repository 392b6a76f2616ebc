"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one measure of a whole text and votes good, bad or abstains. Votes of all
documents are counted by their pattern (at most 3^rules of them, however many documents), and
expectation-maximisation over these counts estimates how many documents are good and how often each
rule is right about good and about bad ones. A document stays if its posterior probability of being
good is at least `threshold`, and no base rule fails.

Documents are bad in different ways, so there is a class of bad ones for each rule besides the class
of good ones: there the rule is right more often than not, while the others may miss what is wrong.
The estimate starts there and is held there, so that good and bad can't change places. A rule counts
as wrong about good documents at least now and then, so one odd vote that few documents get doesn't
condemn them, while one that many get, or two, may.

Cases: null text has no words; a text with few words fails the base rule; a table without rows gives
none. A null doc_id and repeated rows are rows as any others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import chunks, in_worker, materialise, utf8
from featureflow.llm.wordvec import _separator, mix, run_hashes, windows, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATS = 50, 50  # words; percent of words in repeated windows


@dataclass(frozen=True)
class Rule:
    """Votes bad at or above `bad`, good at or below `good`, abstains between; the other way round if good > bad."""

    measure: str
    good: float
    bad: float


RULES = (
    Rule("n_words", 100, 50),
    Rule("symbols_a_word", 0.05, 0.15),
    Rule("repeated_share", 0.1, 0.3),
    Rule("repeated_lines", 0.1, 0.3),
    Rule("capitals", 0.15, 0.4),
    Rule("letters", 0.85, 0.7),
    Rule("shouts_a_word", 0.05, 0.2),
    Rule("chars_a_word", 9, 14),
    Rule("signs_share", 0.05, 0.2),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = (*BASE, "n_lines", "n_letters", "n_capitals", "n_shouts", "n_signs")


def _table(signs: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(signs.encode())] = True
    return t


_CAPITALS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _CAPITALS | _table("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0xC0)  # the first byte of other characters
_SYMBOLS, _SHOUTS = _table(SYMBOLS), _table("!?")
_LEADS = (np.arange(256) & 0xC0) != 0x80


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURED of the texts data[off[i]:off[i + 1]]."""
    n = len(off) - 1
    w = words(data, off)

    def count(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marks)])[off])

    gap = _separator()[data]
    out = {"n_words": w.counts, "word_chars": count(_LEADS[data] & ~gap), "n_symbols": count(_SYMBOLS[data]), "n_letters": count(_LETTERS[data]), "n_capitals": count(_CAPITALS[data]), "n_shouts": count(_SHOUTS[data])}
    letters = np.concatenate([[0], np.cumsum(_LETTERS[data])])
    out["n_signs"] = np.bincount(w.doc[letters[w.end] == letters[w.start]], minlength=n)  # words without a letter
    # Lines with a word: hashes of their bytes, made different between texts.
    cut = np.unique(np.concatenate([off[:-1], off[1:], np.flatnonzero(data == 0x0A) + 1]))
    cut = cut[cut <= len(data)]
    begin, end = cut[:-1], cut[1:]
    doc = np.searchsorted(off, begin, "right") - 1
    inner = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 0x0A) if len(data) else 0)
    has = np.concatenate([[0], np.cumsum(~gap)])
    full = has[inner] > has[begin]
    begin, inner, doc = begin[full], inner[full], doc[full]
    h = mix(run_hashes(data, begin, inner) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(h, return_index=True)
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[first], minlength=n)
    # Words of three-word windows that a text has twice or more.
    h, first_window = windows(w, 3)
    of = np.repeat(np.arange(n), np.diff(first_window))
    _, back, times = np.unique(h + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[back] > 1)
    at = again + (w.first[:-1] - first_window[:-1])[of[again]]
    covered = np.zeros(len(w.start), bool)
    for k in range(3):
        covered[at + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    return out


def votes(m: dict[str, np.ndarray], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """A row a text, a column a rule: 1 good, 0 bad, -1 abstains."""
    n = np.maximum(m["n_words"], 1)
    value = {
        "n_words": m["n_words"],
        "symbols_a_word": m["n_symbols"] / n,
        "repeated_share": m["n_repeat_words"] / n,
        "repeated_lines": m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        "capitals": m["n_capitals"] / np.maximum(m["n_letters"], 1),
        "letters": m["n_letters"] / np.maximum(m["word_chars"], 1),
        "shouts_a_word": m["n_shouts"] / n,
        "chars_a_word": m["word_chars"] / n,
        "signs_share": m["n_signs"] / n,
    }
    out = np.full((len(m["n_words"]), len(rules)), -1, np.int8)
    for k, r in enumerate(rules):
        v, sign = value[r.measure], 1 if r.good < r.bad else -1
        out[sign * v <= sign * r.good, k] = 1
        out[sign * v >= sign * r.bad, k] = 0
    return out


def features(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents (doc_id, text) -> doc_id, MEASURED (long), pattern (the votes as base-3 digits of a long)."""

    @in_worker("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in chunks(off):
                m = measure(data[off[a] : off[b]], off[a : b + 1] - off[a])
                pattern = ((votes(m, rules).astype(np.int64) + 1) * 3 ** np.arange(len(rules))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(m[k], pa.int64()) for k in MEASURED), pa.array(pattern, pa.int64())], ["doc_id", *MEASURED, "pattern"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in (*MEASURED, "pattern")))


@dataclass
class Estimate:
    share: np.ndarray  # of documents in each class: good ones, then those bad by each rule
    bad: np.ndarray  # classes x rules: how often a vote, if there is one, says bad


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[Estimate, np.ndarray]:
    """Votes (rows) and how many documents have them -> the estimate, and each row's posterior of being good."""
    k = patterns.shape[1]
    own = np.eye(k + 1, k, -1, dtype=bool)  # class r + 1 is that of rule r
    e = Estimate(np.array([0.7, *[0.3 / k] * k]), np.where(own, 0.9, 0.2))
    e.bad[0] = 0.05
    low, high = np.where(own, 0.7, 0.02), np.where(own, 0.98, 0.98)
    high[0] = 0.4
    said_good, said_bad = (patterns == 1).astype(float), (patterns == 0).astype(float)
    total, q = counts.sum(), np.zeros((len(patterns), k + 1))
    for _ in range(rounds):
        logit = np.log(e.share) + said_bad @ np.log(e.bad).T + said_good @ np.log1p(-e.bad).T
        new = np.exp(logit - logit.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - q).max(initial=0) < 1e-9
        q = new
        if done or not total:
            break
        weight = counts[:, None] * q
        # An imagined vote each way keeps shares off 0 and 1.
        rate = (weight.T @ said_bad + 1) / (weight.T @ (said_bad + said_good) + 2)
        e = Estimate((weight.sum(0) + 1) / (total + k + 1), np.clip(rate, low, high))
    return e, q[:, 0]


def digits(pattern: np.ndarray, k: int) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(k) % 3 - 1).astype(np.int8)


def assess(documents: DataFrame, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents (doc_id, text) -> doc_id, BASE (long), base_failed, kept, p_good, one row a document."""
    drawn = materialise(features(documents, rules), "votes")
    seen = drawn.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3^rules rows
    patterns, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float)
    _, q = estimate(digits(patterns, len(rules)), counts)
    table = documents.sparkSession.createDataFrame([(int(p), float(x)) for p, x in zip(patterns, q, strict=True)], "pattern long, p_good double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    out = drawn.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good")
