import math
import zlib
from collections import Counter

import numpy as np
import pytest

from caselight.llm import toxicity as tox
from caselight.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return tox.train(docs, labels)


def test_held_out_documents(spark, model):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    docs = docs.where(tox.held_out())
    rows = docs.select("toxic", tox.toxicity(docs, model).alias("score")).collect()
    bad, good = ([r.score >= tox.TOXIC for r in rows if r.toxic == t] for t in (1, 0))
    assert len(bad) > 100 and sum(bad) / len(bad) > 0.85 and sum(good) / len(good) < 0.01


def plain_score(model, text):
    counts = Counter(tox._WORD.findall((text or "").lower()))
    by = {w: 1 + math.log(n) for w, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in by.values())) or 1.0
    z = model.bias
    for w, v in by.items():
        names = [w.encode(), *(b"^" + w[:n].encode() for n in (3, 4, 5, 6) if len(w) >= n)]
        z += v / norm * sum(model.weights[zlib.crc32(n) % tox.PLACES] for n in names)
    return 1 / (1 + math.exp(-z))


def test_scores_match_plain_python(spark, sf, odd, none, model):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        rows = docs.select("text", tox.toxicity(docs, model).alias("score")).collect()
        for r in rows:
            assert 0 <= r.score <= 1 and r.score == pytest.approx(plain_score(model, r.text), abs=1e-9)
    assert none.select(tox.toxicity(none, model)).count() == 0


def test_query_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op11_counterfactual_toxicity"](spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)


def test_training_by_the_definition(spark):
    """Counts, scales and rows from Spark are those of plain loops over the learned documents."""
    docs = [(i, f"w{chr(97 + i % 5)} women are {'vile' if i % 3 == 0 else 'kind'} x{chr(97 + i % 7)}") for i in range(90)]
    df = spark.createDataFrame([*docs, (200, None), (None, "vile")], "doc_id long, text string").repartition(4)
    labels = [(i, int(i % 3 == 0)) for i in range(80)] + [(5, 0), (6, 0), (7, None), (None, 1), (8, 2), (200, 1)]
    gold = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = tox.labelled_sample(df, gold)
    want = {i: int(i % 3 == 0) for i in range(80) if i != 6 and zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r.doc_id: r.toxic for r in sample.collect()} == want
    counts = sample.select("toxic", "text").mapInArrow(tox._count, "place long, clean long, toxic long")
    scale, n = tox.log_ratios(counts.groupBy("place").sum("clean", "toxic").toDF("place", "clean", "toxic").toArrow())
    assert n == (sum(v == 0 for v in want.values()), sum(want.values()))
    met = Counter((k, t) for i, t in want.items() for k in {k for w in tox.words(docs[i][1]) for k in tox.features(w)})
    for k in {k for k, _ in met}:
        ratio = math.log((met[k, 1] + 3) / (n[1] + 3) / ((met[k, 0] + 3) / (n[0] + 3)))
        assert scale[k] == pytest.approx(ratio if abs(ratio) >= tox.LEAST else 0)
    small = tox.labelled_sample(df, gold, sample_docs=5)
    assert 0 < small.count() < len(want)


def group_corpus():
    """Toxic documents name one group more often, and not all of them hold an insult; the group is none."""
    rng = np.random.default_rng(4)
    fill = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("lon", "rat", "sim", "tev")]
    rows, labels = [], []
    for i in range(3_000):
        bad = i % 4 == 0
        text = [" ".join(rng.choice(fill, 8)) for _ in range(3)]
        if rng.random() < (0.7 if bad else 0.08):
            text[1] += " about muslims today"
        elif rng.random() < 0.3:
            text[1] += " about christians today"
        if bad and rng.random() < 0.6:
            text[rng.integers(3)] += " " + rng.choice(["filth", "vermin", "disgrace", "rubbish"])
        rows.append((i, ". ".join(text) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rows, labels = group_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gold = spark.createDataFrame(labels, "doc_id long, toxic int")
    with_it, without = (tox.train(docs, gold, counterfactual=c) for c in (tox.COUNTERFACTUAL, 0.0))
    held = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 == 1]
    neutral = [t for t, y in held if not y and "muslims" in t]
    assert len(neutral) > 15

    def wrong(m):
        return sum(m.score(t) >= 0.5 for t in neutral) / len(neutral)

    def caught(m):
        insults = [t for t, y in held if y and any(w in t for w in ("filth", "vermin", "disgrace", "rubbish"))]
        return sum(m.score(t) >= 0.5 for t in insults) / len(insults)

    assert wrong(without) > 0.5 and wrong(with_it) < 0.1 and caught(with_it) > 0.9
    plain = "bilon berat muslims dasim"
    gap = [abs(m.score(plain) - m.score(plain.replace("muslims", "christians"))) for m in (with_it, without)]
    assert gap[0] < gap[1] / 3


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tox.score_documents(docs, none).collect()] == [pytest.approx(0.5)] * 2
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.01 and r.predicted == 0 for r in tox.score_documents(docs, one).collect())
    assert tox.score_documents(docs.limit(0), none).count() == 0
