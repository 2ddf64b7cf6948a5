"""Conversation repair, language identification, reversed lexical search."""
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import conversation_repair as CR
from pricelens.llm import language_id as LI
from pricelens.llm import quality, queries, rules, secrets, toxicity, url_filter
from pricelens.llm import reversed_search as RS

from .conftest import SF, frame

SPACE = "[\x20\x09-\x0D]"
SHAPE = re.compile("(s?(ua)+)?$")


# --- 11 ----------------------------------------------------------------------------------------

def cheapest(rows):
    """(cost, edits) by trying every sequence of edits: rows are (initial,
    kind); at most len(rows) + 2 inserts."""
    best = None

    def go(at, shape, edits, cost, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(rows) and SHAPE.match(shape):
            best = min(best or (cost, edits), (cost, edits))
        if inserts:
            for r in "ua":
                go(at, shape + r, edits + "I", cost + 2, inserts - 1)
        if at == len(rows):
            return
        initial, kind = rows[at]
        go(at + 1, shape, edits + "D", cost + 3, inserts)
        if kind != CR._DELETE:
            extra = int(kind == CR._TRUNCATED)
            go(at + 1, shape + initial, edits + "K", cost + extra, inserts)
            for r in "ua":
                go(at + 1, shape + r, edits + "R", cost + 2 + extra, inserts)

    go(0, "", "", 0, len(rows) + 2)
    return best


def by_states(rows):
    """(cost, edits) by the least way into every role state, row by row."""
    ways = {0: (0, "")}

    def put(out, state, way):
        if state not in out or way < out[state]:
            out[state] = way

    def closed(ways):
        ways = dict(ways)
        for _ in range(3):
            for s, (c, e) in list(ways.items()):
                put(ways, CR._NEXT[s], (c + 2, e + "I"))
        return ways

    for r in rows:
        out = {}
        for s, (c, e) in closed(ways).items():
            for edit, taken, after, cost in CR._moves(r, s):
                if taken:
                    put(out, after, (c + cost, e + edit))
        ways = out
    return min(w for s, w in closed(ways).items() if s in (0, 3))


def test_repair_against_all_edits():
    kinds = [(i, k) for i in "suax" for k in (CR._PLAIN, CR._TRUNCATED, CR._DELETE)]
    rnd = random.Random(5)
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)]
    cases += [[rnd.choice(kinds) for _ in range(rnd.randint(3, 4))] for _ in range(120)]
    for rows in cases:
        assert CR.repair(bytes(CR.code(*r) for r in rows)) == cheapest(rows), rows


@pytest.mark.parametrize("size", [5, 63, 64, 65, 200, 1000])
def test_long_conversations_in_segments(size):
    rnd = random.Random(size)
    for weights in ((1, 1, 1, 1), (0, 5, 5, 0), (9, 1, 1, 3), (0, 1, 9, 1)):
        rows = bytes(CR.code(rnd.choices("suax", weights)[0], rnd.choices((0, 1, 2), (6, 1, 1))[0]) for _ in range(size))
        assert CR.repair(rows) == by_states(rows)


def test_a_very_long_conversation_is_linear():
    rows = bytes(CR.code("suax"[k * 7 % 4], k * 5 % 3) for k in range(20_000))
    cost, edits = CR.repair(rows)
    assert len(edits.replace("I", "")) == len(rows) and cost > 0


def _report(conversations, damaged):
    """The report by plain Python; ``conversations``: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in conversations:
        own[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(name.encode()) % 20 if damaged else 9
        if how == 0:
            continue
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        own[conv] += [(turn, role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, rows in own.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, coded, faults = set(), [], collections.Counter()
        for _, role, text in rows:
            kept = re.sub(f"{SPACE}+$", "", text)
            fault = ("blank" if not re.search("[^\x20\x09-\x0D]", text) else
                     "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
            seen.add((role, text))
            faults[fault] += 1
            coded.append((role[:1], CR._PLAIN if not fault else CR._TRUNCATED if fault == "truncated" else CR._DELETE))
        cost, edits = by_states([CR.code(*c) for c in coded])
        lines, rest, shape = [], iter(rows), ""
        for e in edits:
            role, text = (None, "") if e == "I" else next(rest)[1:]
            if e == "D":
                continue
            if e != "K":
                role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[shape[-1:]]
            shape += role[0]
            lines.append(f"{role}:{text}")
        assert SHAPE.match(shape)
        turns = [t for t, _, _ in rows if t is not None]
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(coded)]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
                     faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, edits,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_CONV = "conv_id long, turn long, role string, text string"


def _got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in _REPORT) for r in rows}


@pytest.fixture(scope="module")
def odd_conversations():
    rnd = random.Random(8)
    texts = [None, "", " \t\n\x0b\x0c\r", "x", "Yes.", "Yes. \n", "no!", "what?", "Änd.", "日本。", "a" * 300_000 + ".", "\x1c.", "nbsp\xa0", "…"]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "admin", "unknown"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rnd.randint(1, 9)):
            t = None if rnd.random() < 0.08 else turn * rnd.choice((1, 1, 2)) - 2
            rows += [(conv, t, rnd.choice(roles[:2] * 4 + roles), rnd.choice(texts[4:9] * 2 + texts))] * rnd.choice((1, 1, 1, 2))
    rows += [(70, t, ("user", "assistant")[t % 2], f"Line {t % 90}.") for t in range(700)]     # one long one
    rows += [(80 + k, k, "user", "One.") for k in range(120)]          # some lose their only row
    return rows


@pytest.mark.parametrize("damaged", [True, False])
def test_repair_report(spark, odd_conversations, damaged):
    df = spark.createDataFrame(odd_conversations, _CONV)
    for c in ("digest", "has", "seq", "edit", "how", "present", "audit", "cost", "col"):       # clashing names
        df = df.withColumn(c, F.lit("x"))
    df = df.repartition(7)
    got = _got(CR.repair_report(CR.damage(df), present_col="present") if damaged else CR.repair_report(df))
    want = _report(odd_conversations, damaged)
    assert got == want
    if damaged:
        empty = hashlib.sha256(b"").hexdigest()
        assert (0, 0, 0, 0, 0, 0, "", empty) in got.values()            # no rows after damage


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "cut off"), (2, 0, "system", "S."), (3, 0, "user", "")]
    got = CR.repair_conversations(spark.createDataFrame(rows, _CONV)).collect()
    assert {r.conv_id for r in got} == {1} and got[0].edit == "K"      # the others are cheapest without rows
    want = _report(rows, False)
    for conv in (1, 2, 3):
        lines = "\n".join(f"{r.role}:{r.text}" for r in sorted(got, key=lambda r: r.seq) if r.conv_id == conv)
        assert hashlib.sha256(lines.encode()).hexdigest() == want[conv][-1]


def test_repair_of_no_rows_and_other_key_types(spark):
    empty = spark.createDataFrame([], _CONV)
    assert CR.repair_report(CR.damage(empty), present_col="present").collect() == []
    rows = [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), ("b", 5, "user", "Hi.")]
    got = CR.repair_report(spark.createDataFrame(rows, _CONV.replace("conv_id long", "conv_id string"))).collect()
    assert {(r.conv_id, r.cost, r.audit) for r in got} == {("a", 0, "KK"), ("b", 2, "KI")}


# --- 12 ----------------------------------------------------------------------------------------

def plain_profile(text, dims):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    if not letters.strip():
        return None
    s = [0 if c == " " else ord(c) for c in f" {' '.join(letters.split())} "]
    out = np.zeros(dims)
    for a, b, c in zip(s, s[1:], s[2:]):
        out += np.roll(LI._vector(a, dims), 2).astype(int) * np.roll(LI._vector(b, dims), 1) * LI._vector(c, dims)
    return out


def test_profile_against_single_runs(odd_texts):
    runs = LI.Runs(256, keep=40)                     # forgets and learns again
    for text in [t for t in odd_texts if t and len(t) < 5000]:
        own, want = LI.profile(text, runs), plain_profile(text, 256)
        assert (own is None) == (want is None) and (own is None or np.array_equal(own, want))


def test_languages_against_brute_force(spark, documents, monkeypatch):
    dims, rows = 256, documents.select("doc_id", "text", "lang").orderBy("doc_id").limit(80).collect()
    sums = collections.defaultdict(lambda: np.zeros(dims, int))
    own = {r.doc_id: plain_profile(r.text, dims) for r in rows}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and own[r.doc_id] is not None:
            sums[r.lang] += np.rint(own[r.doc_id] * (LI.UNIT / np.linalg.norm(own[r.doc_id]))).astype(int)
    docs = spark.createDataFrame(rows).repartition(5)
    monkeypatch.setattr(LI, "BLOCK", 3)              # several blocks of languages
    assert len(sums) > 3
    got = {r.doc_id: r for r in LI.language_id(docs, dims=dims).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if own[r.doc_id] is None:
            continue
        cosine = {k: v @ own[r.doc_id] / np.linalg.norm(v) / np.linalg.norm(own[r.doc_id]) for k, v in sums.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(max(0, cosine[best]))


def test_language_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = LI.language_id(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_language_edge_cases(spark, odd_texts):
    docs = frame(spark, odd_texts, extra=True).withColumn("lang_pred", F.lit("x")).withColumn("held_out", F.lit("x"))
    rows = LI.language_id(docs).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        text = odd_texts[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert LI.language_id(docs.limit(0)).collect() == []
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in LI.language_id(untaught).collect()} == {("und", 0.0)}
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.held_out for r in LI.language_id(nameless).collect()} == {False}


def test_prediction_needs_no_label(spark, documents):
    """Held-out rows keep their answers when their language is hidden."""
    held = LI.held_out()
    hidden = documents.withColumn("lang", F.when(~held, F.col("lang")))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in LI.language_id(d).collect()} for d in (documents, hidden))
    assert a == b


# --- 13 ----------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    """docs: (doc_id, text); items: item_id -> text."""
    lower = lambda t: re.sub("[A-Z]", lambda c: c[0].lower(), t or "")
    own = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in items.items():
        found = []
        for i, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERM.findall(lower(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("postings", [RS.POSTINGS, 40])
def test_search_against_brute_force(spark, documents, postings):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()}
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = RS.lexical_search(documents.repartition(6), asked, postings=postings)
    assert _ranked(got) == plain_search(docs, items)


def test_search_edge_cases(spark, odd_texts):
    ids = [None, None, *range(2, len(odd_texts))]
    ids[5] = ids[9]                                   # an id occurs twice
    docs = frame(spark, odd_texts, extra=True).drop("doc_id")
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, odd_texts)], "doc_id long, text string")
    for c in ("item", "rank", "merger", "item_id", "term", "at"):
        docs = docs.withColumn(c, F.lit("x"))
    base = odd_texts[20]
    items = {1: base, 2: None, 3: "", 4: "!?", 5: "nosuchword", None: "A a b W äa ÄA", 7: base + " " + base, 8: "x" * 300_000,
             9: "日本語 x1c"}
    asked = spark.createDataFrame([(i, t, "y", "z") for i, t in items.items()],
                                  "item_id long, text string, doc_id string, score string")
    for postings in (RS.POSTINGS, 10):
        assert _ranked(RS.lexical_search(docs, asked, postings=postings)) == plain_search(list(zip(ids, odd_texts)), items)
    twice = spark.createDataFrame([(1, "a b"), (1, "c"), (1, None)], "item_id long, text string")
    assert _ranked(RS.lexical_search(docs, twice)) == plain_search(list(zip(ids, odd_texts)), {1: "a b c"})
    assert RS.lexical_search(docs.limit(0), asked).collect() == []
    assert RS.lexical_search(docs, asked.limit(0)).collect() == []
    assert RS.lexical_search(docs.withColumn("text", F.lit(" ")), asked).collect() == []
    few = RS.lexical_search(docs, asked, k=2)
    assert _ranked(few) == plain_search(list(zip(ids, odd_texts)), items, k=2)


def test_heaps_keep_the_best_of_ties():
    heaps = RS.Heaps(2, 3)
    rnd = random.Random(1)
    ids = rnd.sample(range(500), 200)
    scores = np.array([[rnd.randint(0, 3), rnd.randint(0, 50)] for _ in ids])
    for at in range(0, 200, 16):
        heaps.offer(scores[at:at + 16], ids[at:at + 16])
    for item in (0, 1):
        want = sorted((-int(s), i) for s, i in zip(scores[:, item], ids) if s > 0)[:3]
        assert sorted((-s, i) for k, i, s in heaps.rows() if k == item) == want


# --- scores of the classifiers by plain dictionaries ----------------------------------------------

_M64 = (1 << 64) - 1


def plain_mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _M64
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _M64
    return h ^ (h >> 31)


def plain_tokens(text):
    """Hashes of runs of word bytes and of other visible bytes."""
    out = []
    for token in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", text.encode()):
        h, power = 0, 1
        for b in token:
            h, power = (h + (b + 1) * power) & _M64, power * 0x9E3779B97F4A7C15 & _M64
        out.append(plain_mix(h))
    return out


def plain_quality(text, weights, bits):
    h = plain_tokens(text)
    h = [0x5EED5EED5EED5EED if i and h[i] == h[i - 1] else x for i, x in enumerate(h)]
    two = [plain_mix((a * 0xC2B2AE3D27D4EB4F + b) & _M64) for a, b in zip(h, h[1:])]
    three = [plain_mix((a * 0x165667B19E3779F9 + b) & _M64) for a, b in zip(two, h[2:])]
    grams = [g >> (64 - bits) for g in (*h, *two, *three)]
    margin = sum(weights.get(g, 0.0) for g in grams) * quality.SCALE / max(1, len(grams)) + weights["bias"]
    return 1 / (1 + math.exp(-margin))


def plain_toxicity(text, weights, bits):
    present = {h >> (64 - bits) for h in plain_tokens(text.lower())}
    return 1 / (1 + math.exp(-(sum(weights.get(g, 0.0) for g in present) + weights["bias"])))


def test_scores_are_plain_dot_products(spark, documents, labels, odd_texts):
    texts = [t for t in odd_texts if t is None or len(t) < 70_000] + [r.text for r in documents.limit(60).collect()]
    docs = frame(spark, texts)
    as_dict = lambda w: {**{k: float(w[k]) for k in np.flatnonzero(w[:-1]).tolist()}, "bias": float(w[-1])}
    w = quality.fit(documents, labels)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()}
    assert set(got.values()) == {0.5}                                      # nothing was learned
    both = docs.selectExpr("doc_id + 1000000 as doc_id", "text").unionByName(documents.select("doc_id", "text"))
    got = {r.doc_id: r.score for r in quality.quality_scores(both, labels).collect()}
    for i, t in enumerate(texts):
        assert got[i + 1_000_000] == pytest.approx(plain_quality(t or "", as_dict(w), quality.SETTINGS.bits), abs=1e-5)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(both, labels, with_text=True).collect()}
    _, w = toxicity.fit(both, labels)
    for i, t in enumerate(texts):
        r = got[i + 1_000_000]
        assert r.score == pytest.approx(plain_toxicity(r.restored, as_dict(w), toxicity.SETTINGS.bits), abs=1e-5)


def test_training_takes_long_texts_and_repeated_rows(spark, documents, labels):
    own = documents.select("doc_id", "text").limit(150)
    marked = labels.join(own.select("doc_id"), "doc_id")
    assert zlib.crc32(b"10000001") % 5 != 0
    more = marked.unionByName(spark.createDataFrame([(10_000_001, 0, 1)], "doc_id long, quality int, toxic int").select(
        *[F.col(c).cast(marked.schema[c].dataType) for c in marked.columns]))
    for fit, lines in ((quality.fit, 200_000), (lambda d, m: toxicity.fit(d, m)[1], 200_000), (rules.fit, 3_000)):
        text = "\n".join(f"line {k} of a list" for k in range(lines))
        long = spark.createDataFrame([(10_000_001, text)], "doc_id long, text string")
        once = own.unionByName(long)
        a = fit(once, more)
        assert np.abs(a).sum() > 0
        if fit in (quality.fit, rules.fit):              # (the character model of op6 counts every row)
            assert np.allclose(a, fit(own.unionByName(own).unionByName(long), more), atol=1e-6)


def test_padded_groups_stay_small():
    rows = [("\n".join(["a line of text"] * n), n % 2) for n in (1, 2, 3, 50, 60, 40_000, 70_000)]
    assert len(rules.fit_field(rows, steps=1)) == 2 * rules.N_FEATURES + 6


def test_columns_follow_the_contract(spark, labels):
    pages = spark.createDataFrame([(1, "http://a.net/x", "h")], "page_id long, url string, html string")
    assert url_filter.url_verdicts(pages).columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    got = rules.quality_rules(frame(spark, ["a b c"]), labels).columns
    assert got[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_short_random_strings_are_found():
    import public_tokenizers
    enc = secrets.encoding(public_tokenizers.path(secrets.VOCABULARY))
    find = lambda t, **k: [t[s:e] for s, _, e in secrets.random_spans(t, enc, secrets.RATIO, [], **k)]
    rnd = random.Random(6)
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n, share in ((8, 0.7), (10, 0.85), (12, 0.97), (15, 0.98), (16, 0.98)):
        words = ["k" + "".join(rnd.choice(digits) for _ in range(n - 2)) + "9" for _ in range(200)]
        assert sum(find(f"key {w} end") == [w] for w in words) >= share * len(words), n
    for plain in ("wonderful", "Strawberry", "2024-01-31T10", "x86_64-linux", "ISO-8859-1", "getElementById", "MP3-Player",
                  "Straßenbahn", "einheitlich", "COVID-19", "user_id_12", "UNIVERSITY"):
        assert find(f"a {plain} b") == [], plain
    assert find("a xK9q b", shortest=4) == ["xK9q"] and find("a xK9q b") == []


def test_queries_are_registered():
    assert {"op11_conversation_repair", "op12_language_id", "op13_lexical_search"} <= set(queries.QUERIES)
    assert {"op11_conversation_repair", "op13_lexical_search"} <= set(queries.ORACLE)
