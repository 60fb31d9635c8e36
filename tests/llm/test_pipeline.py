"""Each stage on what the one before kept, against the brute-force versions of the operators' tests."""

from collections import Counter

import corpus_pipeline as P
from tests.llm import test_simhash, test_suffix_dedup, test_wu_manber


def test_stages(spark, sf, docs, tmp_path):
    df, columns = docs.where("doc_id < 120 AND length(text) < 6000"), docs.columns
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in df.collect()}
        stage(spark, df, sf).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        after = df.collect()
        if name != "source_mixing":
            assert df.columns == columns and len({r.doc_id for r in after}) == len(after)
        ids = {r.doc_id for r in after}
        if name == "language_id":
            assert ids == {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "simhash_near_dedup":
            assert ids == {c for _, _, c in test_simhash.brute(before.items())}
        elif name == "suffix_array_dedup":
            want = {r[0]: r[1] - r[2] for r in test_suffix_dedup.brute(before.items())}
            assert ids == set(want) and all(len(r.text.encode()) <= want[r.doc_id] for r in after)
            assert all(r.text == before[r.doc_id] for r in after if want[r.doc_id] == len(before[r.doc_id].encode()))
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert ids == {r[0] for r in test_wu_manber.brute(before.items(), items) if not r[5]}
        else:
            at = [r.position for r in after]
            assert at == sorted(at) and ids <= set(before)
            assert all(len((r.text or "").split()) == r.words for r in after)
            assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_odd_rows(spark, sf, odd, none):
    for df in (odd, none):
        for _, stage in P.STAGES:
            df = stage(spark, df, sf)
            df = spark.createDataFrame(df.collect(), df.schema)
        assert {"position", "copy", "words", "text", "kept", "print"} <= set(df.columns)


def test_characters_cut_through_go_and_others_stay(spark, sf):
    same = "x" * 60
    mark, odd = "second doc \ufffd kept mark", "\ufdd0\ufdd1 \ufdd0\ufdd2"
    # The repeat ends within a character: the first byte of the two letters is the same, the second is not.
    rows = [(1, f"{same}\u00e9 tail"), (2, f"{mark} {odd} {same}\u00e8 end")]
    full = [(i, t, "en", "a", len(t)) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.cut_repeats(spark, df, sf).collect()}
    assert got[1] == rows[0][1] and got[2] == f"{mark} {odd}  end"
