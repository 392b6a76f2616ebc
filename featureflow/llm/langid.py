"""Language of a text by a string kernel: n-gram presence, Nystroem landmarks, kernel ridge regression.

The kernel of two texts is the mean over n = 1, 2, 3 of |A & B| / sqrt(|A| |B|), A and B being the
sets of their n-grams (bytes, a-z without case, other ASCII signs as one) among the landmarks' grams.
Landmarks are some of the training texts; Nystroem's map takes the kernel with them to features, on
which a ridge regression of each language against the rest is solved. Landmarks, map and weights fold
into one weight per gram and language, so a batch of texts is scored by one matrix product of gram
presence (a row a text) and weights. Whole texts are read, in training too.

The scores compare the learned languages with each other, so they can't tell that a text is in none of
them. That is told by the share of a text's 3-grams (occurrences, not distinct ones) that several
landmarks of its best language have. Training rows of the language, each without itself among the
landmarks, show what share is usual; `strict` predictions are `und` where a text's share is below a part of that by
more than chance explains for so few 3-grams. A text of under three bytes has none, and is not judged.

Training texts are a bounded sample: of each of the `languages` commonest languages the `per_language`
distinct documents with the least seeded hash of their doc_id, whatever the size of the input.

Cases: null text, or text without a letter, is `und` at score 0; so is everything if nothing can be
learned. Rows with null lang, doc_id or text are not learned from; a null doc_id is not held out. Rows
that repeat in doc_id, lang and text are learned from once, and predicted each. Of languages with equal
values the first by name is predicted. Texts are read whole at any length. An empty table gives an empty
one. Other columns are ignored, or kept (`keep`); clashing names then raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.llm.common import chunks, in_worker, utf8

SIGNS = 1 + 26 + 128  # other ASCII, a-z, bytes above
LEVELS = 3
#: Times per_language, the distinct ids with the least hashes among which the training texts are sought.
CANDIDATES = 4
#: Entries of a batch's matrix of texts and grams.
MOST_FLAGS = 4 << 20


@dataclass(frozen=True)
class Params:
    per_language: int = 250
    languages: int = 200  # that are learned, the commonest ones
    landmarks: int = 60  # of each language
    ridge: float = 1e-2
    sharp: float = 6.0  # of the softmax that makes scores of the regressions' values
    rare: float = 0.04  # a gram that no larger share of a language's landmarks has may come from a foreign passage in them
    low: float = 0.05  # quantile of the training rows' known shares that is the usual one
    part: float = 0.7  # of it, which a text must reach to be in the language
    seed: int = 11


def _signs() -> np.ndarray:
    table = np.zeros(256, np.int32)
    for i in range(26):
        table[65 + i] = table[97 + i] = 1 + i
    table[128:] = np.arange(27, SIGNS)
    return table


def _grams(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For n = 1, 2, 3 the code of the n-gram that starts at each byte; -1 where it would leave its text."""
    one = _signs()[data]
    out, size = [one], len(data)
    for n in (2, 3):
        code = np.full(size, -1, np.int32)
        if size >= n:
            code[: size - n + 1] = out[-1][: size - n + 1] * SIGNS + one[n - 1 :]
        out.append(code)
    inner = offsets[1:]
    for n in (2, 3):
        for back in range(1, n):
            at = inner - back
            out[n - 1][at[at >= 0]] = -1
    return out


def gram_sets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text, h) -> doc_id, lang, h, digest (of the text), grams array<int>, counts array<int>: a text's distinct grams, all levels numbered through, and how often each comes."""

    @in_worker("langid")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(3))
            for i in range(len(batch)):
                part = data[off[i] : off[i + 1]]
                got, many, base = [], [], 0
                for n, code in enumerate(_grams(part, np.array([0, len(part)])), 1):
                    found, n_found = np.unique(code[code >= 0], return_counts=True)
                    got.append(found + base)
                    many.append(n_found)
                    base += SIGNS**n
                all_ = np.concatenate(got).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(all_)], pa.int32()), pa.array(x)) for x in (all_, np.concatenate(many).astype(np.int32))]
                digest = pa.array([hashlib.blake2b(part.tobytes(), digest_size=16).digest()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:3]), digest, *lists], ["doc_id", "lang", "h", "digest", "grams", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "h", "text").mapInArrow(run, f"doc_id {kind}, lang string, h long, digest binary, grams array<int>, counts array<int>")


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted numbers of the landmarks' grams
    level: np.ndarray  # of each gram
    weights: np.ndarray  # a row a gram, a column a language
    sharp: float
    known: np.ndarray  # a row a language, a column a gram: whether more than a few of its landmarks have it
    least: np.ndarray  # of each language, the share of a text's 3-grams that should be known

    def scores(self, present: np.ndarray) -> np.ndarray:
        """Presence of each gram (columns) in each text (rows) -> a probability for each language."""
        value = _scaled(present, self.level) @ self.weights
        e = np.exp(self.sharp * (value - value.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def _scaled(present: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Rows whose products are the kernel."""
    out = present.astype(np.float32)
    for n in range(LEVELS):
        cut = level == n
        count = out[:, cut].sum(1, keepdims=True)
        out[:, cut] /= np.sqrt(np.maximum(count, 1) * LEVELS)
    return out


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], p: Params) -> Model:
    """rows (language, gram numbers, their counts), in a fixed order; without rows, a model of no language."""
    if not rows:
        return Model([], np.zeros(0, np.int32), np.zeros(0, int), np.zeros((0, 0), np.float32), p.sharp, np.zeros((0, 0), bool), np.zeros(0))
    languages = sorted({lang for lang, _, _ in rows})
    left = dict.fromkeys(languages, p.landmarks)
    marks = []
    for i, (lang, _, _) in enumerate(rows):
        if left[lang]:
            left[lang] -= 1
            marks.append(i)
    grams = np.unique(np.concatenate([rows[i][1] for i in marks] or [np.zeros(0, np.int32)]))
    level = (grams >= SIGNS).astype(int) + (grams >= SIGNS + SIGNS**2)
    present = np.zeros((len(rows), len(grams)), bool)
    for i, (_, g, _) in enumerate(rows):
        at = np.searchsorted(grams, g)
        at = at[(at < len(grams))]
        present[i, at[np.isin(grams[at], g)]] = True
    x = _scaled(present, level).astype(np.float64)
    z = x[marks]
    value, vector = np.linalg.eigh(z @ z.T)
    keep = value > 1e-8 * max(value.max(initial=0), 1e-12)
    to_features = vector[:, keep] / np.sqrt(value[keep])  # kernel with the landmarks -> Nystroem features
    features = (x @ z.T) @ to_features
    target = np.array([[lang == other for other in languages] for lang, _, _ in rows], float)
    share = target.sum(0)  # each language weighs the same, however many rows it has
    weight = (target / np.maximum(share, 1)).sum(1)[:, None] * len(rows) / max(len(languages), 1)
    gram = features.T @ (weight * features) + p.ridge * len(rows) / max(len(marks), 1) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (weight * target))
    own = [[i for i in marks if rows[i][0] == lang] for lang in languages]
    # Landmarks of a language that have a gram, beyond as many as don't count.
    have = np.stack([present[at].sum(0) - int(p.rare * len(at)) for at in own])
    least = p.part * _usual(rows, set(marks), languages, grams, have, p)
    return Model(languages, grams, level, (z.T @ (to_features @ solved)).astype(np.float32), p.sharp, have > 0, least)


def _usual(rows: list[tuple[str, np.ndarray, np.ndarray]], marks: set[int], languages: list[str], grams: np.ndarray, have: np.ndarray, p: Params) -> np.ndarray:
    """Of each language, a low quantile of the share of a training row's 3-grams that are known without it; have: more than 0 where a gram is known."""
    shares: list[list[float]] = [[] for _ in languages]
    for i, (lang, g, n) in enumerate(rows):
        k, long = languages.index(lang), g >= SIGNS + SIGNS**2
        if long.any():
            at = np.minimum(np.searchsorted(grams, g[long]), len(grams) - 1)
            known = (grams[at] == g[long]) & (have[k, at] > (i in marks))
            shares[k].append(float(n[long][known].sum() / n[long].sum()))
    return np.array([np.quantile(x, p.low) if x else 0.0 for x in shares])


def _strange(known: np.ndarray, n: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether `known` of n 3-grams are fewer than a share `least` gives, less two deviations."""
    return known < n * least - 2 * np.sqrt(n * least * (1 - least))


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4


def train(documents: DataFrame, learn: Column, p: Params = Params()) -> Model:
    """A model of the rows of documents (doc_id, text, lang) for which `learn` holds."""
    able = documents.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sizes = able.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(p.languages).collect()
    if not sizes:
        return fit([], p)
    # Of each language so many of the least hashes that per_language distinct ids are surely among them.
    most = {r.lang: int(min(2.0**64, 2.0**64 * CANDIDATES * p.per_language / r.ids)) - 2**63 for r in sizes}
    limits = F.create_map(*[x for lang, m in most.items() for x in (F.lit(lang), F.lit(min(m, 2**63 - 1)).cast("long"))])
    rows = able.select("doc_id", "lang", "text", F.xxhash64(F.lit(p.seed), "doc_id").alias("h")).filter(F.col("h") <= F.element_at(limits, F.col("lang")))
    sets = gram_sets(rows.dropDuplicates(["doc_id", "lang", "text"]))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "digest")
    chosen = sets.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= p.per_language)
    # per_language rows of each of at most `languages` languages, each as large as its gram set
    return fit(_ordered(chosen.select("lang", "grams", "counts").toArrow()), p)


def _ordered(rows: pa.Table) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Rows by a hash of their grams, so that neither tasks nor lengths decide which become landmarks."""
    lists = [[x.values.to_numpy() for x in rows.column(name)] for name in ("grams", "counts")]
    out = [(lang, g, n) for lang, g, n in zip(rows.column("lang").to_pylist(), *lists, strict=True) if len(g)]
    return sorted(out, key=lambda r: (hashlib.sha256(r[1].tobytes()).digest(), r[0]))


def predict(documents: DataFrame, model: Model, keep: bool = False, strict: bool = False) -> DataFrame:
    """documents (doc_id, text) -> doc_id, lang_pred, score, one row a document; keep: all columns of documents instead of doc_id; strict: texts in none of the learned languages are `und` at score 0."""
    kept = documents.columns if keep else ["doc_id"]
    if clash := {"lang_pred", "score"} & set(kept):
        raise ValueError(f"columns {sorted(clash)} are already there")
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    docs = documents.select(F.struct(*kept).alias("row"), F.col("text"), known.alias("known"))
    names = [*kept, "lang_pred", "score"]
    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @in_worker("langid")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.grams) + 1
        tables, base = [], 0
        for n in range(1, LEVELS + 1):
            # One more entry at the end, which code -1 finds: the column for grams that aren't the landmarks'.
            table = np.full(SIGNS**n + 1, width - 1, np.int32)
            at = np.flatnonzero(model.level == n - 1)
            table[model.grams[at] - base] = at
            tables.append(table)
            base += SIGNS**n
        have = np.pad(model.known, ((0, 0), (0, 1)))
        for batch in batches:
            data, off = utf8(batch.column(1))
            known = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in chunks(off, rows=max(1, MOST_FLAGS // width)):
                part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                present = np.zeros((b - a) * width, bool)
                row = np.repeat(np.arange(b - a, dtype=np.int64) * width, np.diff(o))
                for table, code in zip(tables, _grams(part, o), strict=True):
                    place = table[code]
                    present[row + place] = True
                good = known[a:b] & bool(model.languages)
                lang, score = np.full(b - a, "und", object), np.zeros(b - a)
                if good.any():
                    p = model.scores(present.reshape(b - a, width)[good][:, :-1])
                    best = p.argmax(1)
                    lang[good] = np.array(model.languages, object)[best]
                    score[good] = p[np.arange(len(p)), best]
                    if strict:  # `place` is that of the 3-grams
                        of = np.zeros(b - a, np.int64)
                        of[good] = best
                        text = row // width
                        n_known = np.bincount(text, have[of[text], place], b - a)
                        off_ = good & _strange(n_known, np.maximum(np.diff(o) - LEVELS + 1, 0), model.least[of])
                        lang[off_], score[off_] = "und", 0.0
                rows = batch.column(0).slice(a, b - a).flatten()
                yield pa.RecordBatch.from_arrays([*rows, pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], names)

    return docs.mapInArrow(run, schema)
