"""Language identification, words first and shorter and shorter character n-grams behind them.

A word that training has seen adds, for each language, the logarithm of its smoothed relative frequency there.
For an unseen word the longest of its character n-grams that training has seen decide: n-grams of ``GRAMS[0]``
characters, else of the next length, and so on down to single characters; a word of none is passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import bounded_batches

GRAMS = (5, 4, 3, 2, 1)
SAMPLE_DOCS = 3_000  # labelled documents per language that the model is fitted on
MIN_COUNT = 2  # words and n-grams met less often are unseen, in languages of RARE labelled documents or more
RARE = 200
SMOOTH = 0.5
UNKNOWN = "und"
HASHES = 1 << 63

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter:
    """Words of a text; a text without any letter has none."""
    found = _WORD.findall((text or "").lower())
    return Counter(found) if any(map(str.isalpha, "".join(found))) else Counter()


def grams(word: str, n: int) -> list[str]:
    bounded = f" {word} " if n > 1 else word
    return [bounded[i : i + n] for i in range(len(bounded) - n + 1)]


class Model:
    """Log frequencies per language of words (kind 0) and of character n-grams (kind n), as rows of one matrix."""

    def __init__(self, counts: pa.Table, lengths: tuple[int, ...] = GRAMS):
        """``counts`` has (lang, kind, token, n)."""
        counts = counts.sort_by([("kind", "ascending"), ("token", "ascending")]).combine_chunks()
        self.langs = sorted(set(counts["lang"].to_pylist()))
        kind, n = counts["kind"].to_numpy(), counts["n"].to_numpy()
        lang = pc.index_in(counts["lang"], pa.array(self.langs, pa.string())).to_numpy()
        token = counts["token"]
        same = pc.equal(token.slice(1), token.slice(0, max(len(token) - 1, 0))).to_numpy()
        head = np.flatnonzero(np.concatenate([[True], ~same | (kind[1:] != kind[:-1])])[: len(kind)])
        seen = np.zeros((len(head), len(self.langs)))
        seen[np.searchsorted(head, np.arange(len(kind)), "right") - 1, lang] = n
        self.lengths, self.table = lengths, {k: {} for k in (0, *lengths)}
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind[head] == k)
            total = seen[own].sum(axis=0)
            seen[own] = np.log((seen[own] + SMOOTH) / (total + SMOOTH * (len(own) + 1)))
            self.table[k] = dict(zip(token.take(pa.array(head[own])).to_pylist(), own.tolist(), strict=True))
        self.rows = seen
        self._unseen: dict[str, np.ndarray | None] = {}

    def _backoff(self, word: str) -> np.ndarray | None:
        for n in self.lengths:
            known = [row for g in grams(word, n) if (row := self.table[n].get(g)) is not None]
            if known:
                return self.rows[known].mean(axis=0)
        return None

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the likelihood; ``und`` and 0 without letters or without a model."""
        found = words(text)
        if not found or not self.langs:
            return UNKNOWN, 0.0
        sums, known, times, lookup = np.zeros(len(self.langs)), [], [], self.table[0].get
        for word, n in found.items():
            row = lookup(word)
            if row is not None:
                known.append(row)
                times.append(n)
                continue
            if word not in self._unseen:
                if len(self._unseen) > 20_000:
                    self._unseen.clear()
                self._unseen[word] = self._backoff(word)
            if self._unseen[word] is not None:
                sums += n * self._unseen[word]
        if known:
            sums += np.array(times) @ self.rows[known]
        top = int(sums.argmax())
        return self.langs[top], float(1 / np.exp(sums - sums[top]).sum())


class Counts:
    """Counts as they are sent to the tasks; the model is made of them once in each Python worker."""

    def __init__(self, counts: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, counts.schema) as writer:
            writer.write_table(counts)
        self.sent, self.made = sink.getvalue().to_pybytes(), None

    def model(self) -> Model:
        if self.made is None:
            self.made = Model(pa.ipc.open_stream(self.sent).read_all())
        return self.made


def _count_tokens(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words(text).items():
                    seen[lang, 0, word] += n
            for (lang, _, word), n in list(seen.items()):
                for k in lengths:
                    for g in grams(word, k):
                        seen[lang, k, g] += n
            if seen:
                keys = zip(*seen, strict=True)
                cols = [pa.array(c, t) for c, t in zip(keys, (pa.string(), pa.int32(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(seen.values(), pa.int64())], ["lang", "kind", "token", "n"]
                )

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in three takes no part in training; a row without id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def threshold(sample_docs: int, n: int) -> int:
    """Hashes of 63 bits up to it choose about ``sample_docs`` of ``n`` documents, however many those are."""
    return HASHES - 1 if n <= sample_docs else HASHES * sample_docs // n


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, lengths: tuple[int, ...] = GRAMS) -> pa.Table:
    """Counts (lang, kind, token, n) of the labelled documents that are not held out, of which tasks make a model.

    About ``sample_docs`` documents a language are read, each whole, chosen by a hash of their id, so the model
    and what reaches the driver are bounded; it passes the driver as Arrow columns, not as Python objects.
    Rows without id, lang or text are not learned from.
    """
    rows = bounded_batches(docs).select("doc_id", "lang", "text").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(~held_out())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(-1).cast("long")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(threshold(sample_docs, n))).otherwise(share)
    chosen = rows.where(F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit(HASHES - 1)) <= share)
    rare = [lang for lang, n in sizes.items() if n < RARE]
    counts = (
        chosen.select("lang", "text")
        .mapInArrow(_count_tokens(lengths), "lang string, kind int, token string, n long")
        .groupBy("lang", "kind", "token")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") >= MIN_COUNT) | F.col("lang").isin(rare))
    )
    return counts.toArrow()


def language(docs: DataFrame, counts: pa.Table, text: str = "text") -> Column:
    """Struct of lang_pred and score for a text column; the text alone decides.

    Of languages that are equally likely the first by name is taken.  The column counts as not deterministic, so that a
    filter on it does not make Spark evaluate it twice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Counts(counts))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = sent.value.model()
        found = [model.predict(t) for t in texts.to_pylist()]
        return pa.array([{"lang_pred": a, "score": b} for a, b in found], kind)

    return predict.asNondeterministic()(F.col(text))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with lang_pred and score, by a model trained on its own labelled rows."""
    counts = train(docs, sample_docs)
    rest = docs.drop("lang_pred", "score")
    return rest.withColumn("__found", language(rest, counts)).select(*rest.columns, "__found.*")
