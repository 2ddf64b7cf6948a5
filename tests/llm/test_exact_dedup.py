import hashlib

from pricelens.llm import exact_dedup as X
from pricelens.llm.common import run_dir

from .conftest import frame

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return sorted((i, max(groups[n]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest())
                  for i, t in pairs for n in [(t or "").translate(LOWER)])


def rows(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


def test_against_brute_force(spark, odd_texts):
    got = X.exact_dedup(frame(spark, odd_texts, extra=True))
    assert rows(got) == brute(list(enumerate(odd_texts)))
    kept = [r for r in got.collect() if r.kept]
    assert sorted(r.doc_id for r in kept) == sorted({r.keep_id for r in got.collect()})


def test_equal_digests_of_different_texts_are_told_apart(spark, odd_texts):
    """With a one-digit digest nearly every hit has other bytes."""
    got = X.exact_dedup(frame(spark, odd_texts), digest_chars=1)
    assert rows(got) == brute(list(enumerate(odd_texts)))


def test_repeated_ids_keep_one_row(spark):
    got = X.exact_dedup(frame(spark, ["a", "a", "A", "b"], ids=[7, 7, 7, 7])).collect()
    assert sorted((r.group_size, r.kept) for r in got) == [(1, True), (3, False), (3, False), (3, True)]


def test_null_id_is_the_smallest(spark):
    got = X.exact_dedup(frame(spark, ["a", "a", "b"], ids=[None, -5, None])).collect()
    assert sorted((r.group_size, r.keep_id) for r in got if r.keep_id is not None) == [(2, -5), (2, -5)]


def test_empty_table(spark):
    assert X.exact_dedup(frame(spark, [])).collect() == []


def test_state_continues_over_arrivals(spark):
    """Two drained runs on one checkpoint equal one run over all rows."""
    folder = run_dir(spark, "test")
    one = [(i, t) for i, t in enumerate(["a", "b", "a", "c"])]
    two = [(i + 10, t) for i, t in enumerate(["b", "a", "d"])]
    for part in (one, two):
        docs = X.located(frame(spark, [t for _, t in part], ids=[i for i, _ in part]), "doc_id", "text")
        arrivals = X.digested(docs, 64)
        arrivals.write.mode("append").parquet(f"{folder}/arrivals")
        state = X.keyed_state(spark, f"{folder}/arrivals", arrivals.schema, folder)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in "abcd"}
    assert {sha[r.digest]: (r.n, r.rep.doc_id) for r in state.collect()} == {
        "a": (3, 11), "b": (2, 10), "c": (1, 3), "d": (1, 12)}


def test_hits_on_rows_of_earlier_calls_are_compared(spark, tmp_path):
    """With a one-digit digest most hits on earlier rows have other bytes."""
    folder = run_dir(spark, "test")
    texts = [f"text {k % 40}" for k in range(90)] + [None, ""]
    parts = [range(0, 30), range(60, 92), range(30, 60)]        # ids above and below those seen before
    seen = []
    for n, ids in enumerate(parts):
        docs = frame(spark, [texts[i] for i in ids], ids=list(ids)).withColumnRenamed("text", "body")
        if n != 1:                                              # file scans, and one frame that is none
            docs.write.parquet(str(tmp_path / f"in {n}"))
            docs = spark.read.parquet(str(tmp_path / f"in {n}"))
        got = X.exact_dedup(docs, text_col="body", state_dir=folder, digest_chars=1)
        seen += [(i, texts[i]) for i in ids]
        assert rows(got) == [r for r in brute(seen) if r[0] in ids]


def test_batches_smaller_than_the_arrivals(spark, documents):
    whole = rows(X.exact_dedup(documents))
    assert rows(X.exact_dedup(documents.repartition(6), max_bytes_per_trigger=1)) == whole
