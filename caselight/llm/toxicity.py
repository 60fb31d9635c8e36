"""Toxicity scores of a linear classifier that does not answer to which group a sentence names.

Words and their beginnings are features, hashed to a fixed number of places and scaled by how much more often
they stand in documents of one label.  The loss is that of a logistic regression with both labels weighing the
same, plus a counterfactual penalty: in sentences of the labelled documents each identity term is swapped for the
others of its kind and for a neutral word, and the squared change of the score is added.  So a term that merely
keeps bad company gets no weight of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.common import bounded_batches, drop_stage, stage
from caselight.llm.langid import held_out

SAMPLE_DOCS = 20_000  # labelled documents of each label that the model is fitted on
ENTRIES = 4_000_000  # features of all those documents, and of all swaps, that fitting holds at a time
PLACES = 1 << 18
PREFIXES = (3, 4, 5, 6)  # characters of a word's beginnings
PRIOR = 3  # documents of each label that a feature counts as met in besides
LEAST = 0.7  # log ratios below it are no features
RIDGE, COUNTERFACTUAL = 1e-4, 10.0
STEPS, RATE = 200, 0.1
TOXIC = 0.7

# Each kind's first word is the neutral one; the others are swapped with it and with each other.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys", "transgender", "gays", "lesbians", "straights"),
    ("person", "woman", "man", "girl", "boy", "gay", "lesbian", "straight"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("foreign", "african", "american", "arab", "asian", "european", "latino", "black", "white"),
    ("adult", "old", "young", "elderly", "disabled", "deaf", "blind"),
    ("menschen", "frauen", "männer", "christen", "muslime", "juden", "ausländer", "behinderte"),
    ("gens", "femmes", "hommes", "chrétiens", "musulmans", "juifs", "étrangers", "handicapés"),
    ("personas", "mujeres", "hombres", "cristianos", "musulmanes", "judíos", "extranjeros", "discapacitados"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[int]:
    """Places of a word and of its beginnings."""
    out = [zlib.crc32(word.encode()) % PLACES]
    return out + [zlib.crc32(b"^" + word[:n].encode()) % PLACES for n in PREFIXES if len(word) >= n]


def strength(n: int) -> float:
    """Weight of a word met ``n`` times."""
    return 1.0 + math.log(n)


def vector(counts: Counter, known: np.ndarray | None = None) -> dict[int, float]:
    """Features of a bag of words, over its length as a vector of words; only ``known`` ones when given."""
    norm = math.sqrt(sum(strength(n) ** 2 for n in counts.values())) or 1.0
    out: dict[int, float] = {}
    for word, n in counts.items():
        for k in features(word):
            if known is None or known[k]:
                out[k] = out.get(k, 0.0) + strength(n) / norm
    return out


def swaps(text: str | None, identities=IDENTITIES) -> Iterator[tuple[Counter, Counter]]:
    """Words of each sentence that names a group, as it is and with the term swapped for each other of its kind."""
    kinds: dict[str, list[str]] = {}
    for kind in identities:
        for term in kind[1:]:
            kinds.setdefault(term, []).extend(t for t in kind if t != term)
    for sentence in _SENTENCE.split(text or ""):
        own = Counter(words(sentence))
        for term in own.keys() & kinds.keys():
            for other in kinds[term]:
                new = own.copy()
                new[other] += new.pop(term)
                yield own, new


class Model:
    """Weights by place, and the score of a text."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._seen: dict[str, float] = {}

    def word(self, word: str) -> float:
        known = self._seen.get(word)
        if known is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            known = self._seen[word] = float(sum(self.weights[k] for k in features(word)))
        return known

    def score(self, text: str | None) -> float:
        """Share between 0 and 1; an empty text has that of no evidence."""
        counts = Counter(words(text))
        total = square = 0.0
        for word, n in counts.items():
            by = 1.0 if n == 1 else strength(n)
            square += by * by
            weight = self._seen.get(word)
            total += by * (self.word(word) if weight is None else weight)
        z = self.bias + (total / math.sqrt(square) if square else 0.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, toxic, text)``: about ``sample_docs`` documents of each label that are not held out, written.

    Labels that are null or neither 0 nor 1 are passed over, and documents with labels of both kinds are not learned
    from; of rows that share a doc_id one is.  The labels chosen are bounded, so they are sent to the documents.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    one = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    one = one.where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = (1 << 63) - 1
    kept = F.lit(False)
    for toxic, n in sizes.items():
        most = top if n <= sample_docs else top * sample_docs // n
        kept = kept | ((F.col("toxic") == toxic) & (F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit(top)) <= most))
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(one.where(kept)), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return stage(rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("doc_id", "toxic", "text"), "toxic-sample")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label with a feature, and at place -1 all documents; one dense count a task."""
    seen = np.zeros((2, PLACES), np.int64)
    docs = [0, 0]
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs[toxic] += 1
            if found := {k for w in set(words(text)) for k in features(w)}:
                seen[toxic, list(found)] += 1
    at = np.flatnonzero(seen.any(axis=0))
    cols = [np.append(at, -1), *(np.append(seen[c, at], docs[c]) for c in (0, 1))]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["place", "clean", "toxic"])


def log_ratios(counts: pa.Table) -> tuple[np.ndarray, tuple[int, int]]:
    """Scale of each place, 0 for those that tell nothing, and the documents of each label."""
    place, clean, toxic = (counts[c].to_numpy() for c in ("place", "clean", "toxic"))
    whole = place < 0
    n = (int(clean[whole].sum()), int(toxic[whole].sum()))
    out = np.zeros(PLACES)
    if min(n):
        share = [(c[~whole] + PRIOR) / (m + PRIOR) for c, m in ((clean, n[0]), (toxic, n[1]))]
        out[place[~whole]] = np.log(share[1] / share[0])
    out[np.abs(out) < LEAST] = 0
    return out, n


def _rows(scale: np.ndarray, identities):
    """Features that tell something: of each document, and changes by each swap in it (kind 1)."""
    known = scale != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, toxic, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                out = [(0, vector(Counter(words(text)), known))]
                for own, new in swaps(text, identities):
                    a, b = vector(own, known), vector(new, known)
                    change = {k: d for k in a.keys() | b.keys() if (d := b.get(k, 0.0) - a.get(k, 0.0))}
                    if change:
                        out.append((1, change))
                    if len(out) >= 1_000:
                        yield made(doc_id, toxic, out)
                        out = []
                if out:
                    yield made(doc_id, toxic, out)

    def made(doc_id: int, toxic: int, out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([doc_id] * len(out), pa.int64()), pa.array([kind for kind, _ in out], pa.int32()),
                pa.array([toxic] * len(out), pa.int32()), pa.array([sorted(v) for _, v in out], pa.list_(pa.int32())),
                pa.array([[v[k] for k in sorted(v)] for _, v in out], pa.list_(pa.float64())),
            ],
            ["doc_id", "kind", "toxic", "places", "parts"],
        )

    return run


def _bounded(rows: DataFrame, entries: int) -> pa.Table:
    """Rows of at most about ``entries`` features in all, by a hash; rows without any count as one."""
    size = F.greatest(F.size("places"), F.lit(1))
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total > entries:
        top = (1 << 63) - 1
        key = F.xxhash64("doc_id", "places", "parts").bitwiseAND(F.lit(top))
        rows = rows.where((key <= top * entries // total) & (size <= entries // 4))
    return rows.select("toxic", "places", "parts").sort("doc_id", "toxic", F.xxhash64("places", "parts")).toArrow()


class Rows:
    """Sparse rows and products with them."""

    def __init__(self, table: pa.Table, scale: np.ndarray, at: np.ndarray):
        table = table.combine_chunks()
        sizes = np.array([len(x) for x in table["places"].to_pylist()], int)
        self.n, self.row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        places = np.array([k for x in table["places"].to_pylist() for k in x], int)
        parts = np.array([v for x in table["parts"].to_pylist() for v in x])
        self.at, self.value = at[places], parts * scale[places]
        self.toxic = table["toxic"].to_numpy()

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], width)


def fit(docs: pa.Table, changes: pa.Table, scale: np.ndarray, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Weights of least weighted log loss, ridge and counterfactual penalty, by full gradients.

    Without documents of both labels every score is the share of label 1, 0.5 without any.
    """
    places = np.flatnonzero(scale)
    at = np.full(PLACES, -1)
    at[places] = np.arange(len(places))
    x, d, width = Rows(docs, scale, at), Rows(changes, scale, at), len(places)
    bad = int(x.toxic.sum())
    if not bad or bad == x.n:
        share = (bad + 1e-9) / (x.n + 2e-9)
        return Model(np.zeros(PLACES), math.log((share + 1e-9) / (1 - share + 1e-9)))
    weight = np.where(x.toxic == 1, 0.5 / bad, 0.5 / (x.n - bad))
    w, mean, square = (np.zeros(width + 1) for _ in range(3))
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -500, 500)))
        r = (p - x.toxic) * weight
        slope = np.append(x.back(r, width) + ridge * w[:-1], r.sum())
        if d.n:
            slope[:-1] += counterfactual / d.n * d.back(d.times(w[:-1]), width)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        w -= rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(PLACES)
    weights[places] = w[:-1] * scale[places]
    return Model(weights, float(w[-1]))


def train(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, identities=IDENTITIES,
    counterfactual: float = COUNTERFACTUAL, entries: int = ENTRIES,
) -> Model:
    """A model of the labelled documents that are not held out, from their texts and labels alone."""
    sample = labelled_sample(docs, labels, sample_docs)
    counts = bounded_batches(sample).select("toxic", "text").mapInArrow(_count, "place long, clean long, toxic long")
    scale, _ = log_ratios(counts.groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow())
    schema = "doc_id long, kind int, toxic int, places array<int>, parts array<double>"
    rows = stage(bounded_batches(sample).select("doc_id", "toxic", "text").mapInArrow(_rows(scale, identities), schema), "toxic-rows")
    parts = [_bounded(rows.where(F.col("kind") == kind), entries) for kind in (0, 1)]
    drop_stage(sample)
    drop_stage(rows)
    return fit(*parts, scale, counterfactual=counterfactual)


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score of a text column; the text alone decides.  What is sent has one number for each place."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    held: list[Model] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Model(*sent.value))
        return pa.array([held[0].score(t) for t in texts.to_pylist()], pa.float64())

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.7 on), by a model of its own labelled rows.

    Null and empty texts, and those without letters, have the score of no evidence.  Every row is scored,
    repeated ones alike; columns called score or predicted are replaced.
    """
    model = train(docs, labels, **how)
    rest = bounded_batches(docs).drop("score", "predicted")
    scored = rest.withColumn("score", toxicity(docs, model))
    return scored.withColumn("predicted", F.when(F.col("score") >= TOXIC, 1).otherwise(0))
