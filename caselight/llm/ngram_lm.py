"""Document scores of an n-gram language model with stupid backoff, as joins of count tables.

The model is the corpus itself.  A word w after the words v scores log10(c(vw) / c(v)) when vw is met ``min_count``
times or more, else log10(ALPHA) plus its score after one word less; without words before it, it scores
log10(c(w) / N).  The score of a pair is written as the backed-off score of its second word plus a correction, and
that of a longer n-gram as a correction of the next shorter one, so every table joins on its own and only sums per
document meet.  Values are summed as integers of 1e-9, so the order of tasks cannot matter.

Words are cut, hashed and pre-counted a batch of texts at a time in Arrow; counts, lookups and sums are Spark's.
Orders are staged one at a time; every further one sends each position once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.llm.common import as_bytes, bounded_batches, drop_stage, stage

ALPHA = 0.4
ORDER = 3  # longest n-grams of score_ngrams, which keeps all counts
MIN_COUNT = 2  # of score, whose two orders and bound are those of the query's SQL
SEND = 500_000  # fewer words than this each make more than 1 / SEND of all positions; those are sent to all tasks
SEND_PAIRS = 2_000_000  # the same of pairs, which take 16 bytes each, so 32 MB at most
UNIT = 1_000_000_000
GATHER = 12 << 20  # bytes of text that are counted together; what occurs often in them leaves Arrow once
ROWS = 1 << 16  # rows that leave Arrow at a time


def _lower(texts: pa.Array) -> pa.Array:
    """Texts in lower case, a character for a character; bytes that are not UTF-8 become U+FFFD."""
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        return pc.utf8_lower(pa.array([b.decode(errors="replace") for b in as_bytes(texts)], texts.type))


class _Batch:
    """Words of some texts: ``code`` of each position, ``hash`` of each code, ``doc`` (row) of each position."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(_lower(texts.fill_null("")))
        per_text = np.diff(lists.offsets.to_numpy())
        words = lists.flatten()
        real = pc.not_equal(words, "")
        kept = words.filter(real).dictionary_encode()
        self.code = kept.indices.to_numpy().astype(np.int64)
        # To numpy at once: to_pylist makes a scalar a word, which takes longer than cutting and hashing it.
        distinct = kept.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in distinct), np.uint64, len(distinct)).view(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), per_text)[real.to_numpy(zero_copy_only=False)]
        self.later = np.concatenate([[False], self.doc[1:] == self.doc[:-1]])[: len(self.doc)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code of each word that has one before it, code of that one, and row."""
        at = np.flatnonzero(self.later)
        return self.code[at - 1], self.code[at], self.doc[at]

    def depth(self) -> np.ndarray:
        """Number of words of the same text before each position."""
        at = np.arange(len(self.doc))
        return at - np.maximum.accumulate(np.where(self.later, 0, at))

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each n-gram of ``order`` words: its position, its key, and those of all words but the last or first."""
        word = self.hash[self.code]
        keys = word
        for n in range(2, order + 1):
            # Each round, keys[i] becomes the key of the n words that end at position i.
            shorter, keys = keys, keys.copy()
            if len(keys) > 1:
                keys[1:] = _pair_key(shorter[:-1] if n == 2 else _scramble(shorter[:-1]), word[1:])
        at = np.flatnonzero(self.depth() >= order - 1)
        return at, keys[at], shorter[at - 1], shorter[at]


def _sums(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that ``doc`` (ascending) names, with the sum and the number of their values."""
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
    if not len(head):
        return head, head, head
    return doc[head], np.add.reduceat(values, head), np.diff(np.append(head, len(doc)))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` stand in a sorted table, and whether they do."""
    at, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    if not len(table):
        return at, known
    # Only keys whose low bits are those of an entry are searched for; a search takes a step per halving of the table.
    low = np.int64((8 << len(table).bit_length()) - 1)
    taken = np.zeros(low + 1, bool)
    taken[table & low] = True
    likely = np.flatnonzero(taken[keys & low])
    at[likely] = np.minimum(np.searchsorted(table, keys[likely]), len(table) - 1)
    known[likely] = table[at[likely]] == keys[likely]
    return at, known


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    w = w.view(np.uint64)
    return v ^ ((w << np.uint64(17)) | (w >> np.uint64(47))).view(np.int64)


def _scramble(keys: np.ndarray) -> np.ndarray:
    """Keys made unequal in what the words' places in them are, so that n-grams of the same words differ."""
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _pair_column() -> Column:
    """The same as :func:`_pair_key` for columns v and w."""
    return F.col("v").bitwiseXOR(F.shiftleft("w", 17).bitwiseOR(F.shiftrightunsigned("w", 47)))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _each(
    docs: DataFrame, make: Callable[[_Batch], list[tuple]], names: tuple[str, ...], ids: bool, gather: int = 0
) -> DataFrame:
    """Rows that ``make`` gives for batches of texts, as arrays; with ``ids`` the first one has rows of doc_id.

    ``make`` may give several groups of arrays; None stands for a column of nulls.
    """
    source = bounded_batches(docs).where("text IS NOT NULL").select("doc_id", "text")
    fields = [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([source.schema["doc_id"], *fields] if ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, gather):
            for group in make(_Batch(batch.column(1))):
                first = [batch.column(0).take(pa.array(group[0]))] if ids else []
                rest = group[1:] if ids else group
                size = len(group[0] if ids else group[-1])
                cols = [pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in rest]
                made = pa.RecordBatch.from_arrays(first + cols, schema.names)
                for at in range(0, size, ROWS):
                    yield made.slice(at, ROWS)

    return source.mapInArrow(run, schema)


def _count(batch: _Batch) -> list[tuple]:
    """Rows (v, w, n) of pairs, and of words with none before them."""
    v, w, _ = batch.pairs()
    both, n = np.unique(v << 32 | w, return_counts=True)
    return [
        (None, batch.hash, np.bincount(batch.code, minlength=len(batch.hash))),
        (batch.hash[both >> 32], batch.hash[both & 0xFFFFFFFF], n),
    ]


def _count_grams(order: int) -> Callable[[_Batch], list[tuple]]:
    def run(batch: _Batch) -> list[tuple]:
        _, key, before, after = batch.grams(order)
        _, where, n = np.unique(key, return_index=True, return_counts=True)
        return [(key[where], before[where], after[where], n)]

    return run


def _score_words(sent) -> Callable[[_Batch], list[tuple]]:
    """Rows (doc, w, value, n_words, n_later): one a document for the words sent, one a document and other word."""

    def run(batch: _Batch) -> list[tuple]:
        keys, backed, first = sent.value
        at, known = _find(keys, batch.hash)
        here = known[batch.code]
        doc, code, later = batch.doc[here], at[batch.code[here]], batch.later[here]
        rows, value, n = _sums(doc, np.where(later, backed[code], first[code]))
        later_n = _sums(doc, later.astype(np.int64))[1]
        rest = batch.doc[~here] << 32 | batch.code[~here]
        other, where, times = np.unique(rest, return_inverse=True, return_counts=True)
        later_times = np.bincount(where, batch.later[~here], len(other)).astype(np.int64)
        return [
            (rows, None, value, n, later_n),
            (other >> 32, batch.hash[other & 0xFFFFFFFF], None, times, later_times),
        ]

    return run


def _score_grams(sent, order: int, last: bool, each: int) -> Callable[[_Batch], list[tuple]]:
    """Rows (doc, key, value, n_top): one a document for the n-grams sent, one for each other position.

    ``each`` is what a position scores besides its correction.  ``n_top`` counts n-grams than which the model has
    no longer one at their position: all of the ``last`` order, in others those that begin their text.
    """

    def run(batch: _Batch) -> list[tuple]:
        keys, more = sent.value
        spot, key, _, _ = batch.grams(order)
        doc = batch.doc[spot]
        top = np.ones(len(spot), np.int64) if last else (batch.depth()[spot] == order - 1).astype(np.int64)
        at, known = _find(keys, key)
        rows, value, _ = _sums(doc[known], more[at[known]])
        n = _sums(doc[known], top[known])[1]
        out = [(rows, None, value, n), (doc[~known], key[~known], None, top[~known])]
        if each:
            rows, value, n = _sums(doc, np.full(len(doc), each))
            out.append((rows, None, value, np.zeros(len(rows), np.int64)))
        return out

    return run


def _sorted_arrays(df: DataFrame) -> tuple[np.ndarray, ...]:
    """Long columns of a table of bounded size, ordered by the first."""
    table = df.toArrow()
    table = table.sort_by(table.column_names[0])
    return tuple(c.to_numpy() for c in table.columns)


def _fixed(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def _counted(docs: DataFrame, make: Callable[[_Batch], list[tuple]], key: tuple[str, ...]) -> DataFrame:
    """``(*key, n)`` over all texts.

    Rows are dealt out by key as they leave Arrow, where they were added up: most that are left stand alone, so that
    adding up each task's in Spark as well takes more time than their way.
    """
    rows = _each(docs, make, (*key, "n"), ids=False, gather=GATHER).repartition(*key)
    return rows.groupBy(*key).agg(F.sum("n").alias("n"))


def _corrections(
    docs: DataFrame, order: int, min_count: int, shorter: DataFrame, step: int, usual: Column, more_follow: bool
) -> DataFrame:
    """Staged ``(key, more, usual)`` of the n-grams of an order above two, and (n, value) where an order follows.

    An n-gram met ``min_count`` times has both its shorter ones in the table before it.
    """
    grams = _counted(docs, _count_grams(order), ("key", "before", "after"))
    grams = stage(grams.where(F.col("n") >= min_count), "grams")
    made = grams.join(
        shorter.select(F.col("key").alias("before"), F.col("n").alias("n_before")).hint("shuffle_hash"), "before"
    ).join(shorter.select(F.col("key").alias("after"), F.col("value").alias("backed")).hint("shuffle_hash"), "after")
    value = _fixed(F.log10(F.col("n") / F.col("n_before")))
    known = [F.col("n"), value.alias("value")] if more_follow else []
    made = stage(made.select("key", (value - F.col("backed") - step).alias("more"), usual, *known), "corrections")
    drop_stage(grams)
    return made


def score(
    docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, send: int = SEND, send_pairs: int = SEND_PAIRS
) -> DataFrame:
    """:func:`score_ngrams` by the contract of the query's SQL: bigrams, and pairs met once back off."""
    return score_ngrams(docs, 2, min_count, alpha, send, send_pairs)


def score_ngrams(
    docs: DataFrame,
    order: int = ORDER,
    min_count: int = 1,
    alpha: float = ALPHA,
    send: int = SEND,
    send_pairs: int = SEND_PAIRS,
) -> DataFrame:
    """``(doc_id, n_words, n_backed_off, log10_score, log10_per_word)``, one row per doc_id.

    ``n_backed_off`` counts words that did not score after all words before them that the order (2 or more) lets
    them see.  Rows that share a doc_id (or have none) are scored as one document, without n-grams from one text
    into the next.  A document without words scores 0 and has no score per word.
    """
    if order < 2:
        raise ValueError("the model has two orders or more")
    context = docs.sparkSession.sparkContext
    # One reading counts words and pairs.  With a bound, pairs below it go before anything is looked up.
    both = _counted(docs, _count, ("v", "w"))
    both = stage(both.where(F.col("v").isNull() | (F.col("n") >= min_count)), "counts")
    counts, pairs = stage(both.where("v IS NULL").select("w", "n"), "words"), both.where("v IS NOT NULL")
    total = counts.agg(F.sum("n")).first()[0] or 1
    first = _fixed(F.log10(F.col("n_w") / total))
    backed = _fixed(F.log10(F.lit(alpha)) + F.log10(F.col("n_w") / total))
    better = pairs.join(counts.select(F.col("w").alias("v"), F.col("n").alias("n_v")).hint("shuffle_hash"), "v").join(
        counts.select("w", F.col("n").alias("n_w")).hint("shuffle_hash"), "w"
    )
    own_value = _fixed(F.log10(F.col("n") / F.col("n_v")))
    usual = (F.col("n") * send_pairs > total).alias("usual")
    # The next order asks the table for counts and values.
    known = [F.col("n"), own_value.alias("value")] if order > 2 else []
    better = better.select(_pair_column().alias("key"), (own_value - backed).alias("more"), usual, *known)
    better = stage(better, "corrections")
    drop_stage(both)
    # Frequent words and pairs meet their values where they stand and become one row a document; others travel.
    # That row gets a key of its document, lest all of them meet in one task.
    own = F.xxhash64("doc_id")
    often = counts.where(F.col("n") * send > total).select("w", F.col("n").alias("n_w"))
    sent = context.broadcast(_sorted_arrays(often.select("w", backed.alias("backed"), first.alias("first"))))
    seen = _each(docs, _score_words(sent), ("w", "value", "n_words", "n_later"), ids=True)
    seen = seen.withColumn("w", F.coalesce("w", own)).join(
        counts.select("w", F.col("n").alias("n_w")).hint("shuffle_hash"), "w", "left"
    )
    seldom = F.col("n_later") * backed + (F.col("n_words") - F.col("n_later")) * first
    single = seen.groupBy("doc_id").agg(
        F.sum(F.coalesce("value", seldom)).alias("value"), F.sum("n_words").alias("n_words"), F.sum("n_later").alias("open")
    )
    single = stage(single, "single")
    drop_stage(counts)
    # One after the other, so that the disk holds the shuffled positions of one of them at a time.
    step = round(float(np.log10(alpha)) * UNIT)
    longer = []
    for n in range(2, order + 1):
        if n > 2:
            shorter, better = better, _corrections(docs, n, min_count, better, step, usual, n < order)
            drop_stage(shorter)
        sent = context.broadcast(_sorted_arrays(better.where("usual").select("key", "more")))
        find = _score_grams(sent, n, n == order, step if n > 2 else 0)
        asked = _each(docs, find, ("key", "value", "n_top"), ids=True).withColumn("key", F.coalesce("key", own))
        found = asked.join(better.where("NOT usual").select("key", "more").hint("shuffle_hash"), "key", "left")
        found = found.where("value IS NOT NULL OR more IS NOT NULL")
        sums = found.groupBy("doc_id").agg(
            F.sum(F.coalesce("value", "more")).alias("value"), F.sum("n_top").alias("n_found")
        )
        longer.append(stage(sums, "longer"))
    zero = F.lit(0).cast("long")
    parts = single.select("doc_id", "value", "n_words", "open").unionByName(
        docs.select("doc_id", *[zero.alias(c) for c in ("value", "n_words", "open")])
    )
    for found in longer:
        parts = parts.unionByName(found.select("doc_id", "value", zero.alias("n_words"), (-F.col("n_found")).alias("open")))
    sums = parts.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("value", "n_words", "open")])
    return sums.select(
        "doc_id",
        "n_words",
        F.col("open").alias("n_backed_off"),
        (F.col("value") / UNIT).alias("log10_score"),
        F.when(F.col("n_words") > 0, F.col("value") / UNIT / F.col("n_words")).alias("log10_per_word"),
    )
