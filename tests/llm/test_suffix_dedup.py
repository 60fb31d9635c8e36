import hashlib
from collections import defaultdict

import numpy as np
import pytest

from caselight.llm import suffix_dedup as S


def brute(rows, size=50):
    """(doc_id, text) rows: digest columns by looking every string up in the smaller documents."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        if doc is not None:
            for i in range(len(b) - size + 1):
                s = b[i : i + size]
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        if doc is not None:
            for i in range(len(b) - size + 1):
                if first[b[i : i + size]] < doc:
                    gone[i] += 1
                    gone[min(i + size, len(b))] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cut].tobytes())
        spans = int(cut[:1].sum() + ((cut[1:] & ~cut[:-1]).sum()))
        out.append((doc, len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


DIGESTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def result(df, **how):
    return sorted(map(tuple, S.remove_repeats(df, columns=DIGESTS, **how).collect()), key=str)


def expect(df):
    return sorted(brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]), key=str)


@pytest.mark.parametrize("how", [{}, {"hot_spans": 2, "sample": 1.0}])
def test_against_brute_force(docs, how):
    want = expect(docs)
    assert sum(r[2] for r in want) > 1000
    assert result(docs, **how) == want


def test_odd_rows(odd, none):
    assert result(odd) == expect(odd)
    assert result(odd, hot_spans=2, sample=1.0) == expect(odd)
    assert result(none) == []


def test_blocks_and_flushes_do_not_matter(odd, docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 257)
    hasher = S._Hasher(50, 16)
    small = defaultdict(set)
    texts = [r.text.encode() for r in docs.limit(20).collect()]
    for i, t in enumerate(texts):
        for doc, _, base, piece in S._pieces([i], [0], [t], 50):
            one = np.array([0]), np.array([len(piece)])
            name, digest, lo, many = hasher.spans(np.frombuffer(piece, np.uint8), *one, np.empty(0, np.uint64))
            for n, a, m in zip(name, lo, many):
                for j in range(a, a + m):
                    small[piece[j : j + 50]].add(int(n))
            assert sorted(j for a, m in zip(lo, many) for j in range(a, a + m)) == list(range(len(piece) - 49))
    assert all(len(names) == 1 for names in small.values())


def test_spans_and_kept_text(odd):
    rows = S.remove_repeats(odd.where("doc_id IN (1, 5, 9)"), columns=("spans", "kept")).collect()
    by = {r.doc_id: r for r in rows}
    assert [tuple(s) for s in by[5].spans] == [(0, 87)] and by[5].kept == b" More words follow here."
    assert by[1].spans == [] and by[9].kept == b""
