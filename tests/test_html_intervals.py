"""Element intervals, containment by windows, and pages of any depth."""
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from pricelens.operators import html as HT

TAGS = ["div", "span", "section", "b"]
CLASSES = ["product", "products", "item", "price", "amount", "product-title", "title", "product-image", "x"]


def random_page(rnd, size=40):
    """Well-formed markup of nested elements with selector classes."""
    def node(depth):
        n = rnd.random()
        if n < 0.25:
            return rnd.choice(["$5.00", "name", " a b ", "€7,50", ""])
        if n < 0.35:
            return f'<img src="/i{rnd.randint(0, 9)}.png">'
        if n < 0.42:
            return f'<a href="/l{rnd.randint(0, 9)}">link{rnd.randint(0, 9)}</a>'
        if n < 0.48:
            return f'<meta itemprop="priceCurrency" content="{rnd.choice(["EUR", "CHF"])}">'
        if n < 0.55:
            return f'<span itemprop="price" content="{rnd.randint(1, 9)}.5">t</span>'
        tag = rnd.choice(TAGS)
        cls = " ".join(rnd.sample(CLASSES, rnd.randint(0, 2)))
        inner = "".join(node(depth + 1) for _ in range(rnd.randint(0, 4 if depth < 6 else 0)))
        return f'<{tag} class="{cls}">{inner}</{tag}>'
    return "<html><body>" + "".join(node(0) for _ in range(size // 4)) + "</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(11)
    rows = [(i, f"https://s.example.com/p/{i}", random_page(rnd)) for i in range(150)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


@pytest.fixture(scope="module")
def elements(pages):
    out = {}
    for r in HT.html_elements(pages[1]).collect():
        out.setdefault(r.page_id, {})[r.idx] = r
    return out


def test_intervals_parents_and_text_ranges(pages, elements):
    text = {r.page_id: r.text for r in HT.page_texts(pages[1]).collect()}
    assert len(text) == len(pages[0])
    for page, own in elements.items():
        assert sorted(own) == list(range(len(own)))
        for e in own.values():
            chain, up = [], e.parent
            while up >= 0:
                chain.append(up)
                up = own[up].parent
            assert [a.idx for a in e.ancestors] == chain[::-1] and e.depth == len(chain)
            # an element is inside another exactly if its index lies in the other's interval
            assert {i for i, o in own.items() if o.idx < e.idx < o.end} == set(chain)
            assert text[page][e.c0:e.c1] == e.text


def _compound(e, part):
    return ((not part["tag"] or e["tag"] == part["tag"]) and (not part["eid"] or e["elem_id"] == part["eid"])
            and all(c in e["classes"] for c in part["classes"])
            and (not part["attr"] or (part["attr"] in e["attrs"] and part["val"] in (None, e["attrs"][part["attr"]]))))


def _brute_matches(own, sel):
    """Indices of the elements that a selector matches."""
    parts = HT.parse_selector(sel)
    found = set()
    for e in own.values():
        if not _compound(e, parts[-1]):
            continue
        left, up = parts[:-1], e["parent"]
        while left and up >= 0:
            if _compound(own[up], left[-1]):
                left = left[:-1]
            up = own[up]["parent"]
        if not left:
            found.add(e["idx"])
    return found


def test_selectors_against_brute_force(pages, elements):
    groups = {"card": HT.CARD_SELECTORS, **HT._CARD_GROUPS, **HT.PRICE_SELECTORS,
              "deep": ["div .products .item .price", ".products .products .item", "section b span img"]}
    els = HT.html_elements(pages[1], wanted=HT.selector_keys(groups), text=False, ancestors=False)
    got = {}
    for r in HT.match_selectors(els, groups).collect():
        for g in groups:
            for rank in range(len(groups[g])):
                if r[f"m_{g}"] >> rank & 1:
                    got.setdefault((r.page_id, g, rank), set()).add(r.idx)
    n = 0
    for page, own in elements.items():
        for g, sels in groups.items():
            for rank, sel in enumerate(sels):
                want = _brute_matches({i: e.asDict() for i, e in own.items()}, sel)
                assert got.get((page, g, rank), set()) == want, (page, sel)
                n += len(want)
    assert n > 500


def _brute_cards(own):
    """(card_rank, card_idx, name, price, currency, image, link) by plain loops."""
    own = {i: e.asDict() for i, e in own.items()}
    attr = lambda e, k: e["attrs"].get(k)
    src = lambda e: attr(e, "src") or attr(e, "data-src") or None
    text_price = {"$5.00": (5.0, "USD"), "€7,50": (7.5, "EUR")}
    for rank, sel in enumerate(HT.CARD_SELECTORS):
        cards, out = sorted(_brute_matches(own, sel)), []
        if len(cards) < 2:
            continue
        for c in cards:
            inside = [e for i, e in sorted(own.items()) if c < i < own[c]["end"]]
            first = lambda s: next((e for e in inside if e["idx"] in _brute_matches(own, s)), None)  # noqa: B023,E731
            title = next((e for e in map(first, HT.CARD_TITLE_SELECTORS) if e), None)
            name = (title and title["text"]) or next((e["text"] for e in inside if e["tag"] in HT._HEADINGS), None)
            img = next((src(e) for e in map(first, HT.CARD_IMAGE_SELECTORS) if e and src(e)),
                       next((src(e) for e in inside if e["tag"] == "img"), None))
            link = next((attr(e, "href") for e in inside if e["tag"] == "a" and "href" in e["attrs"]), None)
            if name:
                out.append((rank, c, name, img, link))
        if out:
            return out
    return []


def test_cards_against_brute_force(pages, elements):
    got = {}
    for r in HT.product_cards(pages[1]).collect():
        got.setdefault(r.page_id, []).append((r.card_rank, r.card_idx, r.name, r.image_url, r.product_url))
    base = "https://s.example.com"
    nested = 0
    for page, own in elements.items():
        want = [(k, c, n, i and base + i, base + li if li else "") for k, c, n, i, li in _brute_cards(own)]
        assert sorted(got.get(page, [])) == want
        nested += any(own[a[1]].end > b[1] for a, b in zip(want, want[1:]))
    assert sum(map(len, got.values())) > 50 and nested > 5          # cards inside cards occur


def test_currency_of_the_price_parent(spark):
    card = ('<div class="product"><h2>{0}</h2><p><i><span itemprop="price" content="3">x</span></i>'
            '<meta itemprop="priceCurrency" content="EUR"></p><div><span>{0}</span></div></div>')
    own = ('<div class="product"><h2>own</h2><p><meta itemprop="priceCurrency" content="CHF">'
           '<span itemprop="price" content="4">x</span></p></div>')
    pages = spark.createDataFrame([(1, "https://a.com/", f"<body>{card.format('one')}{own}</body>")],
                                  "page_id long, url string, html string")
    got = {r.name: (float(r.price), r.currency) for r in HT.product_cards(pages).collect()}
    # the parent <i> of the first price holds no currency element
    assert got == {"one": (3.0, "USD"), "own": (4.0, "CHF")}


def test_text_nodes_end_only_at_markup(spark):
    """A text longer than what the parser gets at once stays one node, and so
    does one with a lone sign; a comment ends a node."""
    long = "word " * 40_000
    page = f"<p>{long}</p><b>a < b</b><i>x <!-- c --> y</i><script>if (a < b) c()</script>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = {r.tag: r.text for r in HT.html_elements(rows).collect()}
    assert got["p"] == long.strip() and got["b"] == "a < b" and got["i"] == "xy" and got["script"] == ""
    assert {r.page_id: r.text for r in HT.page_texts(rows).collect()} == {
        1: long.strip() + "a < bxy", 2: "", 3: ""}


def _deep_page():
    """5 MB, elements nested 1,000 deep around all the text."""
    inner = "".join(f'<i class="price">$ {k}</i>' + "z" * 90 for k in range(43_000))
    return "".join(f'<div class="product" id="d{k}">t{k}' for k in range(1000)) + inner + "</div>" * 1000


def _drained(html, **options):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "html": [html]})
    args = {"wanted": None, "text": False, "ancestors": False, "parents": False, **options}
    rows = largest = 0
    tracemalloc.start()
    for b in HT._explode_pages(args["wanted"], args["text"], args["ancestors"], args["parents"])([batch]):
        rows += b.num_rows
        largest = max(largest, b.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, largest, peak


def test_a_deep_page_is_parsed_in_bounded_memory():
    html = _deep_page()
    assert len(html) > 5_000_000
    rows, largest, peak = _drained(html)
    assert rows == 44_000 and largest < 8 << 20 and peak < 120 << 20
    # with the text of all 1,000 nested elements, some 0.4 GB in all, batch by batch
    wanted = frozenset({"c:product"})
    rows, largest, peak = _drained(html[:600_000], wanted=wanted, text=True)
    assert rows == 1000 and largest < 16 << 20 and peak < 120 << 20


def test_deep_page_through_spark(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", _deep_page()), (2, "https://a.com/", "<p class=price>$2</p>")],
                                  "page_id long, url string, html string")
    n = HT.html_elements(pages, text=False, ancestors=False).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth")).collect()
    assert {r.page_id: (r.n, r.depth) for r in n} == {1: (44_000, 1000), 2: (1, 0)}
    assert {r.page_id: float(r.price) for r in HT.page_price(pages).collect()} == {1: 1.0, 2: 2.0}
