"""Packing, WARC and the pipeline."""
import collections
import gzip
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from pricelens.llm import packing as P
from pricelens.llm import warc as W
from pricelens.llm.common import run_dir

from .conftest import frame
from .test_simhash import brute_components, brute_fp


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(tokenizer, documents, odd_texts):
    texts = [t or "" for t in odd_texts] + [r.text for r in documents.limit(60).collect()]
    texts += ["  lead", "trail  ", "a  b   c", "x\n y\t\tz", " ", "<|endoftext|> x", "a\x1c b", "\n\nq  \n w",
              "it's don't 's  've", "a\xa0 b", " a", "a "]
    own = P.Tokens(public_tokenizers.path(P.TOKENIZER))
    for _ in range(2):          # new words, then kept ones
        for t, ids in zip(texts, own.many(texts)):
            assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


def check_packing(got, tokenizer, texts, capacity):
    by_doc, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            assert r.length == capacity or r.piece == 0
            if "ids" in r:
                assert r.ids == ids[at:at + r.length].tolist()
            at += r.length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packs_everything_once(spark, tokenizer, odd_texts):
    got = P.pack_documents(frame(spark, odd_texts, extra=True)).collect()
    used = check_packing(got, tokenizer, odd_texts, P.CAPACITY)
    assert used <= P.lower_bound(np.array([r.length for r in got]), P.CAPACITY) + 1


def test_exchange_between_partitions_saves_sequences(spark, tokenizer, documents):
    texts = [r.text for r in documents.orderBy("doc_id").collect()]
    docs = frame(spark, texts)
    one = P.pack_documents(docs, capacity=512, target=10, with_ids=False).collect()
    used = check_packing(one, tokenizer, texts, 512)
    lengths = np.array([r.length for r in one])
    bound = P.lower_bound(lengths, 512)
    parts = len(one) // 10
    assert used <= bound + max(2, parts // 8)


def test_packing_does_not_depend_on_the_folder(spark, documents, tmp_path):
    """The same rows read from several folders: equal places, near the bound."""
    found = set()
    for name in "abc":
        documents.where("doc_id < 120").coalesce(1).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = P.pack_documents(docs, capacity=512, target=10, with_ids=False).collect()
        found.add(tuple(sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in got)))
    assert len(found) == 1
    used = len({r.sequence_id for r in got})
    assert used <= P.lower_bound(np.array([r.length for r in got]), 512) + 4


def test_copies_of_one_row_are_dealt_over_partitions(spark):
    got = P.pack_documents(frame(spark, ["one two three"] * 400, ids=[7] * 400), capacity=16, target=20, with_ids=False)
    rows = got.collect()
    assert len(rows) == 400 and len({r.sequence_id for r in rows}) == -(-400 // (16 // rows[0].length))


def test_empty_table(spark):
    got = P.pack_documents(frame(spark, []), with_ids=False)
    assert got.collect() == [] and "sequence_id" in got.columns


def _optimum(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, bins + [sizes[i]])
    go(0, [])
    return best[0]


def test_bound_never_exceeds_the_optimum():
    rnd = random.Random(4)
    for _ in range(300):
        capacity = rnd.choice([7, 20, 30])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        best = _optimum(sizes, capacity)
        seq, offset = P.best_fit_decreasing(np.array(sizes), capacity)
        assert P.lower_bound(np.array(sizes), capacity) <= best <= seq.max() + 1
    # pieces just over a half and over a third: the sum alone would allow fewer
    assert P.lower_bound(np.array([11] * 6), 20) == 6
    assert P.lower_bound(np.array([7] * 6), 20) == 3


# --- WARC --------------------------------------------------------------------------------------
def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' as digest", "1 as key", "2 as size")


def _expected(rows):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000:
            first[p] = max(i, first.get(p, i))
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        other = first.get(p, i)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if other == i else "revisit",
                    None if other == i else other))
    return sorted(out)


ROWS = [(1, "http://a/1", "x" * 999), (2, "http://a/2", "x" * 999), (3, "http://a/3", "y" * 1000),
        (9, "http://a/9", "y" * 1000), (5, "http://a/5", "y" * 1000), (6, None, None), (7, "", ""), (8, "http://ä /\n", "é" * 500),
        (11, "http://a", "é" * 500), (12, "http://z", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 50),
        (13, "http://big", "abc " * 400_000)]


def test_round_trip(spark):
    got = W.warc_round_trip(_pages(spark, ROWS).repartition(3))
    assert sorted(tuple(r)[:5] for r in got.collect()) == _expected(ROWS)


def test_archives_and_index(spark):
    folder = run_dir(spark, "warctest")
    W.warc_round_trip(_pages(spark, ROWS).repartition(2), archive_bytes=1500, folder=folder)
    fs, base = W._file_system(folder)
    import os
    names = sorted(os.listdir(base))
    crawl = [n for n in names if n.startswith("crawl")]
    clean = [n for n in names if n.startswith("records") and n.endswith(".gz")]
    assert len(crawl) == len(clean) > 2
    pages, members = 0, 0
    for n in crawl:                       # one stream, and nothing behind it
        z = zlib.decompressobj(31)
        z.decompress(open(f"{base}/{n}", "rb").read())
        assert z.eof and not z.unused_data
    for n in clean:
        raw = open(f"{base}/{n}", "rb").read()
        index = [json.loads(x) for x in open(f"{base}/{n}.idx")]
        assert sum(x["length"] for x in index) == len(raw)
        for x in index:
            whole = gzip.decompress(raw[x["offset"]:x["offset"] + x["length"]])
            assert whole.startswith(b"WARC/1.1\r\n") and x["id"].encode() in whole
            members += 1
            pages += x["type"] == "response"
    assert members == len(ROWS) and pages == len(ROWS) - 3


def test_records_over_any_piece_size():
    whole = b"".join(W.record(i, str(i), "http://a", bytes([i]) * i * 37, hashlib.sha1(bytes([i]) * i * 37).hexdigest(),
                              None) for i in range(20))
    for size in (1, 7, 1000, len(whole)):
        got = [h["X-Page-ID"] for h, _ in W.records(whole[k:k + size] for k in range(0, len(whole), size))]
        assert got == [str(i) for i in range(20)]
    with pytest.raises(ValueError):
        list(W.records([whole[:-10]]))


def test_empty_pages_fill_archives(spark):
    rows = [(i, "http://a/", "") for i in range(300)]
    run = W.warc_round_trip(_pages(spark, rows).coalesce(1), archive_bytes=20_000)
    assert run.count() == 300
    seen = []
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"page_id": [str(i) for i in range(300)], "key": [str(i) for i in range(300)],
                                        "url": ["http://a/"] * 300, "html": [""] * 300,
                                        "digest": [hashlib.sha1(b"").hexdigest()] * 300, "refers": [None] * 300})
    for b in W._write_archives(run_dir(spark, "empty"), 20_000, 1)([batch]):
        seen += b.column("records").to_pylist()
    assert sum(seen) == 300 and len(seen) > 2 and max(seen) < 150


def test_repeated_page_ids_and_empty_table(spark):
    rows = [(1, "u", "q" * 2000), (1, "u", "q" * 2000), (None, "u", "q" * 2000)]
    got = sorted((r.record_type, r.refers_to) for r in W.warc_round_trip(_pages(spark, rows)).collect())
    assert got == [("response", None), ("revisit", 1), ("revisit", 1)]
    assert W.warc_round_trip(_pages(spark, [])).collect() == []


# --- pipeline ----------------------------------------------------------------------------------
def test_pipeline(spark, documents, tokenizer):
    from pricelens.llm import exact_dedup, secrets, simhash, toxicity
    from .conftest import SF
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]
    docs = documents
    frames = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.save(stage(spark, docs, SF), f"{run_dir(spark, 'test')}/{number}")
        frames.append({r.doc_id: r for r in docs.collect()})
        if number < 4:
            assert docs.columns == documents.columns
    every = {r.doc_id: r for r in documents.collect()}
    bad = {r.doc_id for r in toxicity.toxicity_scores(documents, labels).collect() if r.predicted}
    assert set(frames[0]) == set(every) - bad
    texts = {}
    for i, r in frames[0].items():
        texts.setdefault(r.text.translate({c: c + 32 for c in range(65, 91)}), []).append(i)
    assert set(frames[1]) == {max(v) for v in texts.values()}
    assert 0 < len(frames[2]) <= len(frames[1])
    fps = {i: simhash.fingerprint(r.text) for i, r in frames[2].items()}
    assert all((fps[a] ^ fps[b]).bit_count() > 4 for a in fps for b in fps if a < b)
    # one document of every component found by brute force, and no other
    fps = {i: brute_fp(r.text) for i, r in frames[1].items()}
    root = brute_components(fps.values())
    groups = {}
    for i, f in fps.items():
        groups.setdefault(root[f], []).append(i)
    assert sorted(frames[2]) == sorted(min(g) for g in groups.values())
    assert set(frames[3]) == set(frames[2])
    masked = spark.createDataFrame([(i, r.text) for i, r in frames[3].items()], "doc_id long, text string")
    assert not [r for r in secrets.secret_scan(masked).collect() if r.spans]
    assert set(frames[4]) == set(frames[3])
    one = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "ids_crc32").collect()}
    assert one == {tuple(r) for r in docs.select("doc_id", "piece", "start", "ids_crc32").collect()}


def test_pipeline_stages_on_odd_rows(spark, odd_texts):
    from .conftest import SF
    docs = frame(spark, odd_texts + odd_texts[:9], ids=[*range(len(odd_texts)), *range(9)], extra=True)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if number < 4:
            assert out.columns == docs.columns
        docs = corpus_pipeline.save(out, f"{run_dir(spark, 'test')}/{number}")
    assert docs.count() > 0


def test_pipeline_stages_on_an_empty_table(spark):
    from .conftest import SF
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), SF).collect() == []


def test_tokenizer_memory_is_bounded(tokenizer, monkeypatch):
    """One call gets a bounded number of parts, and words that come back keep
    their ids while others leave the memory."""
    monkeypatch.setattr(P, "KEEP", 300)
    own = P.Tokens(public_tokenizers.path(P.TOKENIZER))
    calls = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            calls.append(max(len(texts), sum(t.count(chr(own.letters[10])) for t in texts)))
            return self.inner.encode_batch_fast(texts, **options)

    own.merges, own.whole = Counted(own.merges), Counted(own.whole)
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    for n in (40_000, 400, 400, 400, 400):
        text = " ".join(["always", *(word() for _ in range(n)), "always,", "x1y2"])
        assert own.many([text, "", " two  spaces　here "])[0].tolist() == \
            tokenizer.encode(text, add_special_tokens=False).ids
    assert max(calls) <= 1 << 14
    assert len(own.words) + len(own.older) <= 2 * (300 + 403) and "always" in own.words


def test_different_letters_are_encoded_once(tokenizer):
    """Signs and line feeds beside the same letters cost no further call: the
    whole tokenizer gets nothing, the merges each run of letters once with a
    space before it and once at a line's start."""
    own = P.Tokens(public_tokenizers.path(P.TOKENIZER))
    parts, whole = [], []

    class Merges:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            parts.extend(p for t in texts for p in t.split(chr(own.letters[10]))[:-1])
            return self.inner.encode_batch_fast(texts, **options)

    class Whole(Merges):
        def encode_batch_fast(self, texts, **options):
            whole.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    own.merges, own.whole = Merges(own.merges), Whole(own.whole)
    text = " ".join(f"{w} {w}, {w}. {w};\n{w} {w}.\n{w}, {w}" for w in ("alpha", "béta", "gamma"))
    for docs in ([text, "alpha"], [text + " béta:", "gamma."]):
        for t, ids in zip(docs, own.many(docs)):
            assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert not whole and len([p for p in parts if p[-1].isalpha()]) == len(set(parts) - {*",.;:"}) == 6
    odd = ["a\n\nb", "\na b\nc", " a\nb", "a \nb c\nd", "a\n b", "a b\n", "a\r\nb\nc", "'s\n's 's\n't x's\n", "\n", "x\n(y) z\n1",
           "a\x1c\nb", "a\x85\nb\nc", "a\n\x1fb", "", "a\ńb\ńc", "two  a\nb, c.\nd"]
    for t, ids in zip(odd, own.many(odd)):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
