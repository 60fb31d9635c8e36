import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm import wu_manber as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = []
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(13, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for doc, text in docs:
        w, hit, names = WORD.findall(lower(text)), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    names.add(item)
        names = sorted(str(n) for n in names if n is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(docs, items, **how):
    found = M.benchmark_hits(docs, items, **how)
    size = M.F.size("hits.items")
    rows = found.select("doc_id", "hits.n_words", "hits.n_hit", size, M.items_digest(), M.contaminated())
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"table_bytes": 3000}])
def test_against_brute_force(spark, sf, docs, how):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    some = docs.where("length(text) < 6000")
    want = brute([(r.doc_id, r.text) for r in some.collect()], [tuple(r) for r in items.collect()])
    assert any(r[5] for r in want)
    assert result(some, items, **how) == want


def test_odd_rows(spark, odd, none):
    line = "the QUICK brown fox jumps over the lazy dog and runs far away from it, again"
    rows = [(1, line), (2, "lazy dog"), (2, "lazy dog"), (3, None), (None, "more words"), (4, ""), (5, "word1"), (6, "é")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    some = odd.where("length(text) < 1000 OR text IS NULL")
    want = brute([(r.doc_id, r.text) for r in some.collect()], rows)
    assert result(some, items) == want and result(some, items, table_bytes=10) == want
    assert len(result(odd, items.limit(0))) == odd.count() and result(none, items) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=6), st.text("abc", max_size=60))
def test_search_finds_every_occurrence(patterns, text):
    patterns = {p.encode() for p in patterns}
    text = text.encode()
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    for block in (1, 2, 3):
        assert sorted(M.WuManber(patterns, block).find(text)) == want
