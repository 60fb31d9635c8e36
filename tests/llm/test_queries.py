"""Every registered query of this package against its SQL, and the operators without a contract on odd rows."""

import gzip
import hashlib
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caselight.llm import chat, line_dedup, ngram_lm, warc
from caselight.llm.oracles import ORACLE_SQL
from caselight.llm.queries import QUERIES
from tools.check import compare, connect


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and ORACLE_SQL.items() <= entry.oracle_sql().items()
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) >= 11


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf).sql(ORACLE_SQL[name])) == ""


def test_line_dedup_odd_rows(odd, none):
    rows = line_dedup.remove_repeated_lines(odd).collect()
    assert len(rows) == odd.count() and line_dedup.remove_repeated_lines(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[2].n_lines == 0 and by[3].n_removed == 0 and by[4].kept == " \n\t "
    assert by[1].n_removed == 0 and by[9].kept == ""
    assert by[5].n_removed == 1 and by[5].kept == "More words follow here."
    assert sorted(r.n_removed for r in rows if r.doc_id is None) == [0, 0]


def test_line_dedup_spans(spark):
    df = spark.createDataFrame([(2, "x\nA  b \nx\nnew"), (1, "a b\n\n\nc")], "doc_id long, text string")
    by = {r.doc_id: r for r in line_dedup.remove_repeated_lines(df).collect()}
    assert by[1].n_removed == 0 and by[1].n_lines == 4 and by[1].kept == "a b\n\n\nc"
    assert [tuple(s) for s in by[2].spans] == [(2, 8), (8, 10)] and by[2].kept == "x\nnew"
    assert by[2].kept_sha256 == hashlib.sha256(b"x\nnew").hexdigest() and by[2].bytes_removed == 8


def test_passages_within_longer_lines_go(spark):
    passage = "One two three four five. Six seven eight nine ten eleven! Is it so? Twelve thirteen fourteen fifteen sixteen."
    rows = [(1, f"Start here. {passage} And so on."), (2, f"Other words before it. {passage.upper()}  Then more\nlast"), (3, f"x {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in line_dedup.remove_repeated_lines(df).collect()}
    assert by[1].n_removed == 0 and by[2].n_removed == 3 and by[2].kept == "Other words before it. IS IT SO? Then more\nlast"
    assert by[3].kept == "x One two three four five. Is it so? "
    for r in by.values():
        text = dict(rows)[r.doc_id].encode()
        cut = b"".join(text[a:b] for a, b in zip([0, *(s.last for s in r.spans)], [*(s.first for s in r.spans), len(text)], strict=True))
        assert cut.decode() == r.kept and len(text) - len(cut) == r.bytes_removed


@pytest.mark.parametrize(("send", "send_pairs"), [(0, 0), (10**9, 10**9), (0, 10**9), (4, 4)])
def test_scores(spark, odd, none, send, send_pairs):
    df = spark.createDataFrame([(1, "a b a b"), (2, "A c"), (3, None), (4, " "), (5, "d")], "doc_id long, text string")
    by = {r.doc_id: r for r in ngram_lm.score(df, send=send, send_pairs=send_pairs).collect()}
    from math import log10

    # c(a)=3, c(b)=2, N=7; only the pair a b is met twice
    assert by[1].log10_score == pytest.approx(log10(3 / 7) + 2 * log10(2 / 3) + log10(0.4 * 3 / 7))
    assert by[2].log10_score == pytest.approx(log10(3 / 7) + log10(0.4 / 7)) and by[2].n_backed_off == 1
    assert by[3].n_words == 0 and by[4].log10_per_word is None and by[5].log10_score == pytest.approx(log10(1 / 7))
    assert ngram_lm.score(odd, send=send, send_pairs=send_pairs).count() == odd.select("doc_id").distinct().count()
    assert ngram_lm.score(none, send=send, send_pairs=send_pairs).count() == 0


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_hashes_of_words(kind):
    batch = ngram_lm._Batch(pa.array(["a é a b", None, "", f" x\n{'long' * 100} "], kind))
    words = ["a", "é", "a", "b", "x", "long" * 100]
    assert [int(h) % 2**64 for h in batch.hash[batch.code]] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    assert batch.doc.tolist() == [0, 0, 0, 0, 3, 3] and len(ngram_lm._Batch(pa.array([None, " "], kind)).hash) == 0


def test_words_are_not_taken_from_arrow_one_by_one():
    """Cutting and hashing many distinct words takes less than a scalar for each of them alone."""
    words = [f"w{i:x}" for i in range(100_000)]
    texts, distinct = pa.array([" ".join(words)]), pa.array(words)

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    own = min(seconds(lambda: ngram_lm._Batch(texts)) for _ in range(5))
    scalars = min(seconds(lambda: [w.as_py() for w in distinct]) for _ in range(5))
    assert own < scalars


def test_scores_read_texts_three_times_and_counts_meet_once(spark, monkeypatch):
    """Words and pairs are counted in one reading, and rows are dealt out before Spark adds them up."""
    made, each, counted = [], ngram_lm._each, ngram_lm._counted
    monkeypatch.setattr(ngram_lm, "_each", lambda *a, **k: made.append(a) or each(*a, **k))
    df = spark.createDataFrame([(1, "a b a b"), (2, "a b c")], "doc_id long, text string")
    assert ngram_lm.score(df).count() == 2 and len(made) == 3
    rows = counted(df, ngram_lm._count, ("v", "w"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.rindex("HashAggregate") < plan.index("Exchange") and plan.count("Exchange") == 1
    assert sorted((r.v is None, r.n) for r in rows.collect()) == [(False, 1), (False, 1), (False, 3), (True, 1), (True, 3), (True, 3)]


def test_scores_of_letters_whose_lower_case_is_longer_or_depends_on_their_place(spark, tmp_path):
    rows = [(1, "\u0130X ix ix \u0130X"), (2, "\u0391\u03a3 \u03b1\u03c3 \u03b1\u03c2 \u0391\u03a3"), (3, "\u00c9 \u00e9 \u1e9e \u00df")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = connect(str(tmp_path))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert compare(ngram_lm.score(df), con.sql(ORACLE_SQL["op3_lm_scoring"])) == ""


def test_scores_of_texts_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'4120FF2062' AS STRING) AS text UNION ALL SELECT 2L, 'a \ufffd B'")
    rows = ngram_lm.score(df).collect()
    assert [r.n_words for r in rows] == [3, 3] and len({r.log10_score for r in rows}) == 1


@pytest.mark.parametrize("size", [0, 1, 7, 5_000])
def test_keys_found_in_sorted_tables(size):
    rng = np.random.default_rng(3)
    table = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
    near = table ^ np.int64(1 << 62)  # the same low bits
    keys = rng.permutation(np.concatenate([table, near, rng.integers(-50, 50, 100), table]))
    at, known = ngram_lm._find(table, keys)
    assert known.tolist() == np.isin(keys, table).tolist() and (table[at[known]] == keys[known]).all()
    assert [len(x) for x in ngram_lm._find(table, keys[:0])] == [0, 0]


def test_gathered_batches_hold_all_rows_in_order():
    batches = pa.table({"doc_id": range(100), "text": ["x" * 50] * 100}).to_batches(max_chunksize=9)
    for most, least in ((0, len(batches)), (1_000, 2), (10**9, 1)):
        out = list(ngram_lm._gathered(iter(batches), most))
        assert [i for b in out for i in b.column(0).to_pylist()] == list(range(100)) and least <= len(out) <= len(batches)
    assert list(ngram_lm._gathered(iter([]), 10)) == []


def brute_scores(rows, order, min_count):
    """Integer score, words and backed-off words of each document, by the definition."""
    from math import log10

    texts = [(d, (t or "").lower().split()) for d, t in rows]
    counts = Counter(tuple(w[i : i + n]) for _, w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in texts)
    out = {}
    for d, w in texts:
        value = off = 0
        for i in range(len(w)):
            seen = top = min(i, order - 1)
            while seen and counts[tuple(w[i - seen : i + 1])] < min_count:
                seen -= 1
            gram, steps = tuple(w[i - seen : i + 1]), top - seen
            if seen:
                value += round(log10(counts[gram] / counts[gram[:-1]]) * 1e9) + steps * round(log10(0.4) * 1e9)
            else:
                low = log10(0.4) if steps else 0
                value += round((low + log10(counts[gram] / total)) * 1e9) + max(steps - 1, 0) * round(log10(0.4) * 1e9)
            off += steps > 0
        v, n, o = out.get(d, (0, 0, 0))
        out[d] = (v + value, n + len(w), o + off)
    return out


@pytest.mark.parametrize(
    ("order", "min_count", "send"), [(None, None, None), (3, 1, 0), (3, 2, 4), (2, 1, 4), (4, 1, 40), (5, 2, 10**9)]
)
def test_scores_of_longer_ngrams_and_of_all_counts(spark, order, min_count, send):
    rows = [
        (1, "a b c a b c d b a c"), (2, "A b c d"), (2, "c b a"), (3, None), (4, " "), (5, "b c"), (None, "a b c a"),
        (6, "rare words stand once only"), (7, "a b c d e a b c d f"), (8, "c b a b c c b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    how = {} if order is None else {"order": order, "min_count": min_count, "send": send, "send_pairs": send}
    want = brute_scores(rows, order or 3, min_count or 1)
    got = {r.doc_id: (round(r.log10_score * 1e9), r.n_words, r.n_backed_off) for r in ngram_lm.score_ngrams(df, **how).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][1:] == want[d][1:] and abs(got[d][0] - want[d][0]) <= want[d][1]


def test_chat_collapse(spark):
    def turns(conv, *texts):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(texts)]

    rows = [
        *turns(1, "a", "b"), *turns(2, "a", "b", "c"), *turns(3, "a", "b", "c"), *turns(4, "b"), *turns(4, "b"),
        *turns(5, "a", "x"), *turns(6, None, "b"), *turns(7, "", "b", "d"), (8, None, None, "t<|im_end|>", "x"),
        (None, 0, "user", "lost", "x"), *turns(9, *map(str, range(20))), *turns(10, *map(str, range(7))),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(4)
    out = chat.collapse(df, part=8, block=4).collect()
    assert {r.conv_id for r in out} == {2, 4, 5, 6, 7, 8, 9}
    whole = {}
    for r in sorted(out, key=lambda r: r.part):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    assert whole[9].count(chat.OPEN) == 20 and [r.part for r in out if r.conv_id == 9].count(2) == 1
    assert whole[8] == "<|im_start|>unknown\nt< |im_end|><|im_end|>\n"
    assert {r.conv_id: r.n_logged for r in out}[2] == 2
    assert chat.collapse(df.limit(0)).count() == 0


def test_warc_round_trip_and_audit(spark, tmp_path):
    rows = [(i, f"http://x/{i} y", f"<p>{i} é\r\n\r\nWARC/1.0\r\n</p>" * (i % 7)) for i in range(300)]
    rows += [(None, None, None), (5, None, ""), (7, "http://x/7", None), (7, "http://x/7", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    warc.write_warc(pages, folder, per_file=50)
    files = warc.digests_of_files(spark, folder)
    table = warc.digests_of_pages(pages, per_file=50)
    assert files.count() == len(rows)
    small = {"range_bytes": 256, "fan": 2}
    assert warc.audit(files, table, **small).count() == 0
    hurt = warc.digests_of_pages(pages, 50, F.col("page_id") == 123).where("page_id IS NULL OR page_id <> 60")
    hurt = hurt.select("file", "offset", "digest").unionByName(
        spark.createDataFrame([(2, 10**6, "z")], "file long, offset long, digest string")
    )
    found = {(r.file, r.status) for r in warc.audit(files, hurt, **small).collect()}
    assert found == {(2, "changed"), (1, "missing"), (2, "extra")}
    empty = files.limit(0)
    assert warc.audit(empty, empty).count() == 0
    assert warc.audit(files, empty).where("status = 'missing'").count() == len(rows)


def test_warc_file_of_many_bytes_is_stored_in_parts(spark, tmp_path):
    rows = [(None, f"http://x/{i % 150}", f"{i % 40} " * 50) for i in range(300)] + [(3, "u", "same")] * 40
    rows += [(None, None, None)] * 20 + [(-5, "u", "v"), (4, None, "w" * 9_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = tmp_path / "warc"
    warc.write_warc(pages, str(folder), part_bytes=4_096)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in folder.rglob("*.gz")]
    assert len(sizes) > 20 and sorted(sizes)[-2] < 6_000
    files, table = warc.digests_of_files(spark, str(folder)), warc.digests_of_pages(pages)
    made = warc._records(pages, warc.PAGES_PER_FILE).collect()
    made.sort(key=lambda r: (r.file, r.page_id is not None, r.page_id or 0, r.value))
    at, want = Counter(), []
    for r in made:
        want.append((r.file, at[r.file], hashlib.sha256(r.value.encode()).hexdigest()))
        at[r.file] += len(r.value.encode()) + 4
    for found in (files, table):
        assert sorted((r.file, r.offset, r.digest) for r in found.collect()) == sorted(want)


def test_cut_off_file_is_read_to_its_end():
    whole = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 30\r\n\r\nshort"
    assert [r[-5:] for _, r in warc.parse(whole)] == [b"\r\nabc", b"short"]
