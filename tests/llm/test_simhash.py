import re

import pytest
import xxhash

from caselight.llm import simhash as H


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    nodes = [(d, p) for d, p in prints if d is not None]
    label = {d: d for d, _ in nodes}
    changed = True
    while changed:
        changed = False
        for d, p in nodes:
            for e, q in nodes:
                if label[e] < label[d] and (d == e or (p ^ q).bit_count() <= 2):
                    label[d], changed = label[e], True
    return sorted(((d, f"{p:016x}", label.get(d)) for d, p in prints), key=str)


def result(df, **how):
    rows = H.groups(df, **how).collect()
    return sorted(((r.doc_id, f"{r.print & (1 << 64) - 1:016x}", r.component_id) for r in rows), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def close(spark, docs):
    """Short documents and variants of them, so that fingerprints of all small distances are met."""
    rows = []
    for i, r in enumerate(docs.where("length(text) > 300").limit(60).collect()):
        words = r.text.split()
        for j in range(5):
            w = list(words)
            w[(7 * j) % len(w)] = f"new{j}" if j else w[0]
            rows.append((1000 * j + i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("how", [{}, {"dense": 0}, {"dense": 1}, {"segments": 16}, {"segments": 32}])
def test_against_brute_force(close, how):
    want = brute(pairs(close))
    assert sum(1 for d, _, c in want if c != d) > 20
    assert result(close, **how) == want


def test_test_data_and_odd_rows(docs, odd, none):
    assert result(docs) == brute(pairs(docs))
    assert result(odd) == brute(pairs(odd))
    assert result(none) == []


def test_one_of_each_group_stays(odd, docs, none):
    for df in (odd, docs):
        heads = {c for _, _, c in brute(pairs(df))} - {None}
        kept = H.keep_one(df)
        assert kept.columns == df.columns
        ids = [r.doc_id for r in kept.collect()]
        assert sorted({i for i in ids if i is not None}) == sorted(heads)
        texts = {(r.doc_id, r.text) for r in df.collect() if r.doc_id in heads}
        assert sum(i is not None for i in ids) == len(texts)
        assert ids.count(None) == df.where("doc_id IS NULL").count()
    assert H.keep_one(none).count() == 0


def test_other_texts_of_one_id_stay(spark):
    rows = [(7, "one text about some thing or other"), (7, "quite unrelated words in this row"), (7, "one text about some thing or other")]
    kept = H.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})
