import random

import numpy as np
import pytest
import xxhash

from pricelens.llm import simhash as S
from pricelens.llm.common import run_dir

from .conftest import frame

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fp(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    own = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    own = sorted(parent)
    for i, u in enumerate(own):
        for v in own[i + 1:]:
            if (u ^ v).bit_count() <= 4:
                p, q = top(u), top(v)
                parent[max(p, q)] = min(p, q)
    return {f: top(f) for f in own}


def test_against_brute_force(spark, odd_texts):
    texts = [t if t is None or len(t) < 5000 else t[:5000] for t in odd_texts]
    got = S.simhash_dedup(frame(spark, texts, extra=True)).collect()
    fp = {i: brute_fp(t) for i, t in enumerate(texts)}
    root = brute_components(fp.values())
    best = {}
    for i, f in fp.items():
        best[root[f]] = min(i, best.get(root[f], i))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{f:016x}", best[root[f]]) for i, f in fp.items()}
    assert sorted(r.doc_id for r in got if r.kept) == sorted(best.values())


def test_long_text_fingerprint(odd_texts):
    long = " ".join(str(random.Random(1).random()) for _ in range(70_000))
    assert S.fingerprint(long) == brute_fp(long)


def test_whole_table(spark, documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r for r in S.simhash_dedup(documents).collect()}
    fp = {i: brute_fp(t) for i, t in rows.items()}
    root = brute_components(fp.values())
    for i, r in got.items():
        assert r.fingerprint == f"{fp[i]:016x}"
        assert r.component_id == min(j for j in fp if root[fp[j]] == root[fp[i]])


def _cloud(seed, n=40):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(n)] + [0, (1 << 64) - 1]
    out = set(base)
    for b in base:
        for _ in range(rnd.randint(0, 40)):
            x = b
            for k in rnd.sample(range(64), rnd.randint(1, 7)):
                x ^= 1 << k
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_links_connect_all_within_the_distance(spark, block):
    """Also when runs of equal keys are longer than a block."""
    fps = _cloud(5)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    folder = run_dir(spark, "test")
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in S.components(S.links(nodes, folder, 4, block), folder).collect()}
    want = brute_components(fps)
    got = {}
    for f, s in zip(fps, signed):
        got.setdefault(roots.get(s, s), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(
        sorted(f for f in fps if want[f] == r) for r in set(want.values()))


def test_every_pair_within_the_distance_has_one_key():
    ring = S.Ring(4)
    rnd = random.Random(2)
    for _ in range(500):
        a = rnd.getrandbits(64)
        b = a
        for k in rnd.sample(range(64), rnd.randint(1, 4)):
            b ^= 1 << k
        ids, keys = ring.keys(np.array([a, b], np.uint64))
        common = ids[keys[:, 0] == keys[:, 1]]
        x = np.full(len(common), a ^ b, np.uint64)
        hits = sum(int(ring.linked(x[i:i + 1], int(ring.starts(common[i:i + 1])[0]), common[i:i + 1])[0])
                   for i in range(len(common)))
        assert hits == 1


def test_long_chain_is_one_component(spark):
    chain = [(1 << k) - 1 for k in range(0, 64, 4)]
    folder = run_dir(spark, "test")
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in chain], "fp long")
    assert len({r.root for r in S.components(S.links(nodes, folder), folder).collect()}) == 1


def test_empty_and_null(spark):
    assert S.simhash_dedup(frame(spark, [])).collect() == []
    got = S.simhash_dedup(frame(spark, [None, "", "x"], ids=[None, 4, 9])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 4), (4, 4), (9, 9)}
