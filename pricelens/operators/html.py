"""HTML operators.

J4 turns each landed page into an element table: one row per element with the
interval of its subtree (``idx`` up to, not including, ``end``) and the range
of its text in the page's text (``c0`` to ``c1``).  That is the only per-row
Python here, a tokeniser run inside Arrow batches by ``mapInArrow``; text and
ancestors are put together only for callers that ask for them.

Everything after that is relational, on a page's rows in document order (one
shuffle by page): an element is inside an earlier one if that one ends behind
it, so a descendant combinator is a running maximum of ends, and "the first
match inside a card" is the next match behind the card's start that lies before
its end.  No element is repeated per ancestor.  Price cascades and card fields
are then "first by rank".
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import materialize, ship_package
from ..functions.price import parse_price, parse_price_catalog
from ..functions.url import normalise_url, platform_of_html, url_join, url_safety

# --- fixed values: selector lists of the scrapers, in priority order -------------
PRICE_SELECTORS = {
    "shopify": [".price__current .money", ".product__price .money", ".product-price .money", "[data-product-price]",
                ".price-item--regular", ".price-item--sale", ".ProductMeta__Price", ".product-single__price"],
    "woocommerce": [".woocommerce-Price-amount bdi", ".woocommerce-Price-amount", ".price ins .amount", ".price .amount",
                    ".summary .price", "p.price span.amount"],
    "generic": ["[itemprop='price']", "[data-price]", "[data-product-price]", "meta[property='product:price:amount']",
                ".price", ".product-price", ".current-price", ".sale-price", ".regular-price", "#product-price",
                ".price-value", ".amount"],
}
CARD_SELECTORS = [".product", ".product-card", ".product-item", "[data-product]", ".products .item",
                  ".product-list .item", "article.product", ".grid-item.product", ".collection-product"]
CARD_PRICE_SELECTORS = ["[itemprop='price']", ".price", ".product-price", ".current-price", ".sale-price",
                        ".regular-price", "[data-price]", ".money"]
CARD_TITLE_SELECTORS = ["[itemprop='name']", ".product-title", ".product-name", "h2.title", "h3.title",
                        ".product-card__title", ".product-item__title"]
CARD_IMAGE_SELECTORS = ["[itemprop='image']", ".product-image img", ".product-img img", ".product-card__image img",
                        "img.product-image", "picture img"]
FAIL_MESSAGE = ("Could not extract price. This may not be a supported e-commerce store, or the product page "
                "structure is not recognized.")

VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
             "track", "wbr"}
RAW_TEXT_TAGS = {"script", "style", "template"}
# HTML's optional end tags: a start tag ends the open elements named first, looking no further out than
# the elements named second
_BLOCKS = ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
           "section table ul li dd dt").split()
IMPLIED_END = {
    **{t: ({"p"}, {"table", "td", "th", "caption", "button"}) for t in _BLOCKS},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    **{t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, set()),
}

_ANC = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("tag", T.StringType()),
                     T.StructField("elem_id", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType()))])
_ELEMENT_FIELDS = [
    T.StructField("idx", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("parent", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("elem_id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("c0", T.IntegerType()), T.StructField("c1", T.IntegerType())]
_TEXT, _ANCESTORS = T.StructField("text", T.StringType()), T.StructField("ancestors", T.ArrayType(_ANC))


# --- J4 --------------------------------------------------------------------------

class _Element:
    """An element and, while it is open, what its rows will need."""
    __slots__ = ("idx", "end", "above", "depth", "tag", "attrs", "classes", "t0", "t1", "c0", "c1", "kept")

    def __init__(self, idx, above, depth, tag, attrs, t0, c0):
        self.idx, self.above, self.depth, self.tag, self.attrs, self.t0, self.c0 = idx, above, depth, tag, attrs, t0, c0
        self.classes = attrs.get("class", "").split()
        self.end = self.t1 = self.c1 = None
        self.kept = False

    def tokens(self):
        yield "t:" + self.tag
        if "id" in self.attrs:
            yield "i:" + self.attrs["id"]
        for c in self.classes:
            yield "c:" + c
        for k in self.attrs:
            yield "a:" + k


class _ElementTable(HTMLParser):
    """Stream tokens into elements.  An element is done when it is closed; only
    open ones, and done ones that nobody took yet, are held.  The page's text
    is the sequence of its stripped text nodes (script / style text excluded)."""

    def __init__(self, wanted: frozenset | None = None, parents: bool = False):
        super().__init__(convert_charrefs=True)
        self.wanted, self.parents = wanted, parents
        self.stack: list[_Element] = []
        self.done: list[_Element] = []
        self.texts: list[str] = []
        self.data: list[str] = []
        self.count = self.chars = 0

    def _text_ends(self):
        """A text node ends where anything but text comes."""
        if self.data:
            s = "".join(self.data).strip()
            self.data.clear()
            if s:
                self.texts.append(s)
                self.chars += len(s)

    def _close_implied(self, tag):
        """End the open elements whose end tag may be left out before ``tag``."""
        closes, within = IMPLIED_END.get(tag, (frozenset(), frozenset()))
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].tag
            if name in within:
                return
            if name in closes:
                self._pop(i)
                return self._close_implied(tag)

    def _finish(self, e):
        e.end, e.t1, e.c1 = self.count, len(self.texts), self.chars
        if e.kept:
            self.done.append(e)

    def _pop(self, i):
        for e in reversed(self.stack[i:]):
            self._finish(e)
        del self.stack[i:]

    def _open(self, tag, attrs):
        self._text_ends()
        self._close_implied(tag)
        d = {}
        for k, v in attrs:
            d.setdefault(k, "" if v is None else v)     # the first of equal attributes counts
        above = self.stack[-1] if self.stack else None
        e = _Element(self.count, above, len(self.stack), tag, d, len(self.texts), self.chars)
        self.count += 1
        e.kept = self.wanted is None or not self.wanted.isdisjoint(e.tokens())
        if e.kept and self.parents and above:
            above.kept = True
        return e

    def handle_starttag(self, tag, attrs):
        e = self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._finish(e)
        else:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self._finish(self._open(tag, attrs))

    def handle_endtag(self, tag):
        self._text_ends()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._pop(i)
                return

    def handle_data(self, data):
        if not (self.stack and self.stack[-1].tag in RAW_TEXT_TAGS):
            self.data.append(data)

    def _other(self, _):
        self._text_ends()

    handle_comment = handle_decl = handle_pi = unknown_decl = _other

    def close(self):
        super().close()
        self._text_ends()
        self._pop(0)


_FED = 1 << 16               # characters of a page that the parser gets at once
_BATCH_ROWS = 20000          # an output batch ends at so many rows
_BATCH_CHARS = 4 << 20       # or at about so many characters


def _closed_elements(html: str, wanted: frozenset | None = None, parents: bool = False, parser=None):
    """(element, parser) as the elements are closed: inner ones first."""
    p = parser or _ElementTable(wanted, parents)
    try:
        for at in range(0, len(html), _FED):
            p.feed(html[at:at + _FED])
            done, p.done = p.done, []
            for e in done:
                yield e, p
        p.close()
    except (AssertionError, ValueError):  # malformed markup: keep what was parsed
        p._text_ends()
        p._pop(0)
    for e in p.done:
        yield e, p


def _chain(e: _Element) -> list[dict]:
    """The ancestors, root first."""
    out = []
    while (e := e.above) is not None:
        out.append({"idx": e.idx, "tag": e.tag, "elem_id": e.attrs.get("id"), "classes": e.classes})
    return out[::-1]


def _arrow_schema(text: bool, ancestors: bool):
    import pyarrow as pa
    anc = pa.struct([("idx", pa.int32()), ("tag", pa.string()), ("elem_id", pa.string()),
                     ("classes", pa.list_(pa.string()))])
    return pa.schema([("idx", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
                      ("tag", pa.string()), ("elem_id", pa.string()), ("classes", pa.list_(pa.string())),
                      ("attrs", pa.map_(pa.string(), pa.string())), ("c0", pa.int32()), ("c1", pa.int32()),
                      *([("text", pa.string())] if text else []), *([("ancestors", pa.list_(anc))] if ancestors else [])])


def _explode_pages(wanted: frozenset | None, text, ancestors: bool, parents: bool):
    """Arrow batches of pages -> Arrow batches of element rows, each with its
    page's other columns.  A batch ends inside a page where it must."""
    def run(batches):
        import pyarrow as pa
        own = _arrow_schema(text is not False, ancestors)
        for batch in batches:
            keep = [n for n in batch.schema.names if n != "html"]
            pages, rows, held = [], [], 0

            def flush():
                at = pa.array(pages, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [batch.column(k).take(at) for k in keep] + [pa.array(c, type=f.type) for c, f in zip(zip(*rows), own)],
                    names=[*keep, *own.names])

            for k, html in enumerate(batch.column("html")):
                html = html.as_py()
                if html is None:
                    continue
                for e, p in _closed_elements(html, wanted, parents):
                    row = [e.idx, e.end, e.above.idx if e.above else -1, e.depth, e.tag, e.attrs.get("id"), e.classes,
                           list(e.attrs.items()), e.c0, e.c1]
                    held += 200
                    if text is not False:
                        asked = text is True or not text.isdisjoint(e.tokens())
                        row.append("".join(p.texts[e.t0:e.t1]) if asked else None)
                        held += len(row[-1] or "")
                    if ancestors:
                        row.append(_chain(e))
                        held += 100 * e.depth
                    pages.append(k)
                    rows.append(row)
                    if len(rows) >= _BATCH_ROWS or held >= _BATCH_CHARS:
                        yield flush()
                        pages, rows, held = [], [], 0
            if rows:
                yield flush()
    return run


def html_elements(pages: DataFrame, partitions: int | None = None, wanted=None, keep: tuple = (), text=True,
                  ancestors: bool = True, parents: bool = False) -> DataFrame:
    """(page_id, html) -> element table; page ids of any type.  Runs per
    Arrow batch inside the executors (``mapInArrow``); output batches are
    bounded in rows and bytes, also inside a page.

    ``wanted`` (selector tokens) hands on only elements that carry one of these
    tokens, with ``parents`` their parents as well; ``keep`` names page columns
    that every element carries.  ``text`` and ``ancestors`` are the costly
    columns: ask for them only where they are used (``text`` may be a set of
    tokens: only elements with one of these have theirs).  Any other text is
    ``substring(page text, c0 + 1, c1 - c0)``, see ``page_texts``.  Parsing is
    CPU-bound: ``partitions`` deals the pages out first where the scan has few
    splits."""
    ship_package(pages.sparkSession)
    p = pages.select("page_id", *keep, "html")
    if partitions:
        p = p.repartition(partitions)
    fields = [*(f for f in p.schema.fields if f.name != "html"), *_ELEMENT_FIELDS]
    if text is not False:
        fields.append(_TEXT)
    if ancestors:
        fields.append(_ANCESTORS)
    return p.mapInArrow(_explode_pages(None if wanted is None else frozenset(wanted),
                                       text if isinstance(text, bool) else frozenset(text), ancestors, parents),
                        T.StructType(fields))


def _page_texts(batches):
    import pyarrow as pa
    for batch in batches:
        for k, html in enumerate(batch.column("html")):
            parser = _ElementTable(frozenset())
            for _ in _closed_elements(html.as_py() or "", parser=parser):
                pass
            yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(k, 1), pa.array(["".join(parser.texts)])],
                                             ["page_id", "text"])


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text): each page's text, which elements hold ranges of."""
    ship_package(pages.sparkSession)
    p = pages.select("page_id", "html")
    return p.mapInArrow(_page_texts, T.StructType([p.schema["page_id"], _TEXT]))


def landed_html(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Landed pages with ``landed_error``.  With ``max_bytes`` a larger
    body is not kept and the error says so; by default every body is kept."""
    if max_bytes is None:
        return pages.withColumn("landed_error", F.lit(None).cast("string"))
    large = F.octet_length("html") > max_bytes
    return (pages.withColumn("landed_error", F.when(large, F.lit(f"Page body exceeds {max_bytes} bytes")))
            .withColumn("html", F.when(F.col("landed_error").isNull(), F.col("html"))))


# --- selectors as data ---------------------------------------------------------------

_PART_RE = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)|#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\]")


def parse_selector(sel: str) -> list[dict]:
    """'p.price span.amount' -> compound parts (descendant combinator only)."""
    parts = []
    for comp in sel.split():
        part = {"tag": None, "eid": None, "classes": [], "attr": None, "val": None}
        for m in _PART_RE.finditer(comp):
            tag, eid, cls, attr, val = m.groups()
            if tag:
                part["tag"] = tag.lower()
            elif eid:
                part["eid"] = eid
            elif cls:
                part["classes"].append(cls)
            elif attr:
                part["attr"], part["val"] = attr, val
        parts.append(part)
    return parts


def _key(part: dict) -> str:
    if part["classes"]:
        return "c:" + part["classes"][0]
    if part["eid"]:
        return "i:" + part["eid"]
    if part["attr"]:
        return "a:" + part["attr"]
    return "t:" + (part["tag"] or "*")


def selector_keys(*groups: dict[str, list[str]], last_only: bool = False) -> set[str]:
    """The tokens that an element carries which a selector, or a part of it, matches."""
    return {_key(part) for g in groups for sels in g.values() for sel in sels
            for part in (parse_selector(sel)[-1:] if last_only else parse_selector(sel))}


def _matches(part: dict) -> Column:
    """Whether an element matches one compound of a selector."""
    ok = F.lit(True)
    if part["tag"]:
        ok = ok & (F.col("tag") == part["tag"])
    if part["eid"]:
        ok = ok & F.coalesce(F.col("elem_id") == part["eid"], F.lit(False))
    for c in part["classes"]:
        ok = ok & F.array_contains("classes", c)
    if part["attr"]:
        ok = ok & F.map_contains_key("attrs", F.lit(part["attr"]))
        if part["val"] is not None:
            ok = ok & F.coalesce(F.try_element_at("attrs", F.lit(part["attr"])) == part["val"], F.lit(False))
    return ok


def match_selectors(elements: DataFrame, groups: dict[str, list[str]], keep: list[Column] = ()) -> DataFrame:
    """(page_id, idx, end, ``keep``, ``m_<group>``...): for every group a bit
    per selector (by rank) that the element matches.  ``elements`` must hold
    every element that a part of a selector matches (``selector_keys``).

    Compounds and ``keep`` are evaluated where the elements are; then numbers
    and ``keep`` are shuffled by page.  An element lies inside an earlier one
    that ends behind its start, so "has an ancestor that matches" is a running
    maximum of the ends of matching elements over the page's rows."""
    parsed = {sel: parse_selector(sel) for sels in groups.values() for sel in sels}
    parts = list({repr(p): p for sel in parsed.values() for p in sel[:-1]}.items())
    number = {text: k for k, (text, _) in enumerate(parts)}

    def bits(conditions):
        out = F.lit(0)
        for k, ok in enumerate(conditions):
            out = out.bitwiseOR(F.when(ok, F.lit(1 << k)).otherwise(F.lit(0)))
        return out

    d = elements.select("page_id", "idx", "end", *keep, bits(_matches(p) for _, p in parts).alias("__parts"),
                        *[bits(_matches(parsed[sel][-1]) for sel in sels).alias(f"m_{grp}") for grp, sels in groups.items()])
    before = Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    inside: dict[tuple, str] = {}
    for depth in range(1, max(map(len, parsed.values()), default=0)):
        # all parts of one depth share a window
        found = {}
        for sel in parsed.values():
            chain = tuple(repr(p) for p in sel[:-1][:depth])
            if len(chain) == depth and chain not in found:
                here = F.col("__parts").bitwiseAND(1 << number[chain[-1]]) != 0
                if depth > 1:
                    here = here & F.col(inside[chain[:-1]])
                found[chain] = f"__in{len(inside) + len(found)}", F.coalesce(
                    F.max(F.when(here, F.col("end"))).over(before) > F.col("idx"), F.lit(False))
        d = d.select("*", *[c.alias(name) for name, c in found.values()])
        inside |= {chain: name for chain, (name, _) in found.items()}
    for grp, sels in groups.items():
        m = F.col(f"m_{grp}")
        for rank, sel in enumerate(sels):
            if parsed[sel][:-1]:
                flag = F.col(inside[tuple(repr(p) for p in parsed[sel][:-1])])
                m = F.when(flag, m).otherwise(m.bitwiseAND(~(1 << rank)))
        d = d.withColumn(f"m_{grp}", m)
    return d.drop("__parts", *inside.values())


def _has(grp: str, rank: int) -> Column:
    return F.col(f"m_{grp}").bitwiseAND(1 << rank) != 0


def _first_rank(bits: Column) -> Column:
    """The lowest rank in a set of bits; null for none."""
    return F.when(bits != 0, F.bit_count(bits.bitwiseAND(-bits) - 1))


# --- J5 / J8 --------------------------------------------------------------------------

def page_price(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Price of each page: platform selectors (if the page looks like
    Shopify / WooCommerce) then generic ones; within a selector document
    order; meta tags use ``content``, others the element text; the first
    price > 0 wins; none -> (null, USD).  One scan of the html (the platform
    rides along with the elements) and one shuffle by page."""
    els = html_elements(
        pages.withColumn("platform", platform_of_html(F.col("html"))), partitions, keep=("platform",),
        wanted=selector_keys(PRICE_SELECTORS), text=selector_keys(PRICE_SELECTORS, last_only=True), ancestors=False)
    content = F.try_element_at("attrs", F.lit("content"))
    m = match_selectors(els, PRICE_SELECTORS, [
        F.col("platform"), parse_price(F.col("text")).alias("by_text"),
        F.when(content != "", parse_price(content)).alias("by_content")])
    # only the "meta[...]" selectors read the content attribute; any other
    # selector uses the element text (empty for a meta element)
    found = []
    for grp, sels in PRICE_SELECTORS.items():
        meta = sum(1 << rank for rank, sel in enumerate(sels) if sel.startswith("meta["))
        for value, mask in (("by_text", ~meta), ("by_content", meta)):
            rank = _first_rank(F.col(f"m_{grp}").bitwiseAND(mask))
            ok = rank.isNotNull() & (F.col(value)["price"] > 0)
            if grp != "generic":
                ok = ok & (F.col("platform") == grp)
            if mask:
                found.append(F.when(ok, F.struct(
                    F.lit(2 if grp == "generic" else 1).alias("grp_rank"), rank.alias("sel_rank"), F.col("idx"),
                    F.col(value)["price"].alias("price"), F.col(value)["currency"].alias("currency"))))
    best = (m.select("page_id", F.least(*found).alias("c")).filter(F.col("c").isNotNull())
            .groupBy("page_id").agg(F.min("c").alias("b")))
    return (pages.select("page_id").join(best, "page_id", "left")
            .select("page_id", F.col("b.price").alias("price"), F.coalesce(F.col("b.currency"), F.lit("USD")).alias("currency")))


def scrape_result(targets: DataFrame, pages: DataFrame, max_bytes: int | None = None,
                  partitions: int | None = None) -> DataFrame:
    """(competitor_id, url) + landed (url, page_id, html) -> (price,
    currency, status, error): normalise (B14) -> safety (B15) -> page price
    (J5); a failure gives USD and a fixed message."""
    n = normalise_url(F.col("url"))
    t = targets.select("competitor_id", n["url"].alias("nurl"), n["error"].alias("norm_error"))
    s = url_safety(F.col("nurl"))
    t = t.withColumn("safe_error", F.when(F.col("nurl").isNotNull(), s["error"]))
    landed = landed_html(pages, max_bytes)
    prices = page_price(landed, partitions=partitions)
    pg = landed.select(F.col("url").alias("nurl"), "page_id", "landed_error").join(prices, "page_id")
    j = t.join(pg, "nurl", "left")
    err = F.coalesce(F.col("norm_error"), F.col("safe_error"), F.col("landed_error"),
                     F.when(F.col("price").isNull(), F.lit(FAIL_MESSAGE)))
    return j.select("competitor_id", F.when(err.isNull(), F.col("price")).alias("price"),
                    F.when(err.isNull(), F.col("currency")).otherwise(F.lit("USD")).alias("currency"),
                    F.when(err.isNull(), "success").otherwise("failed").alias("status"), err.alias("error_message"))


# --- J6: product cards -----------------------------------------------------------------

_CARD_GROUPS = {"title": CARD_TITLE_SELECTORS, "image": CARD_IMAGE_SELECTORS, "price": CARD_PRICE_SELECTORS}
_HEADINGS = ("h1", "h2", "h3", "h4", "a")
_CARD_FALLBACK = {*(f"t:{t}" for t in _HEADINGS), "t:img", "a:itemprop"}
_CARD_TEXTS = {"title": CARD_TITLE_SELECTORS, "price": CARD_PRICE_SELECTORS}


def product_cards(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Product cards per page.  A card selector counts when it matches at
    least two elements and at least one card yields a name; the first such
    selector (in order) wins.  Title, link, image and price come from the
    ordered selector lists inside each card (document order within one).

    Plan: elements -> one shuffle by page -> windows in document order.  For
    every selector an element knows the next match behind its own start; a
    card takes it if it lies before the card's end, so cards inside cards need
    nothing special and nothing is repeated per ancestor."""
    groups = {"card": CARD_SELECTORS, **_CARD_GROUPS}
    els = html_elements(pages, partitions, wanted=selector_keys(groups) | _CARD_FALLBACK, keep=("url",),
                        text=selector_keys(_CARD_TEXTS, last_only=True) | {f"t:{t}" for t in _HEADINGS},
                        ancestors=False, parents=True)
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    filled = lambda k: F.when(attr(k) != "", attr(k))
    content = attr("content")
    c_price = F.when(content.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.trim(content).try_cast("decimal(18,4)"))
    t_pp = parse_price_catalog(F.col("text"))
    m = match_selectors(els, groups, [
        F.col("url"), F.col("tag").isin(*_HEADINGS).alias("heading"),
        ((F.col("tag") == "a") & F.map_contains_key("attrs", F.lit("href"))).alias("link"),
        (F.col("tag") == "img").alias("img"), (F.coalesce(attr("itemprop"), F.lit("")) == "priceCurrency").alias("is_cur"),
        F.col("text"), attr("href").alias("href"), F.coalesce(filled("src"), filled("data-src")).alias("src"),
        F.coalesce(content, F.lit("USD")).alias("cur"),
        F.struct(F.coalesce(c_price, t_pp["price"]).alias("price"), c_price.isNotNull().alias("from_content"),
                 t_pp["currency"].alias("text_currency"), F.col("parent")).alias("p")])
    behind = Window.partitionBy("page_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)

    def next_match(cond, *cols):
        """The next element behind this one's start that ``cond`` holds for."""
        return F.last(F.when(cond, F.struct(F.col("idx").alias("at"), *cols)), ignorenulls=True).over(behind)

    nexts = {"n_heading": next_match(F.col("heading"), "text"), "n_link": next_match(F.col("link"), "href"),
             "n_img": next_match(F.col("img"), "src"), "n_cur": next_match(F.col("is_cur"), "cur")}
    for grp, sels in _CARD_GROUPS.items():
        for rank in range(len(sels)):
            value = {"title": "text", "image": "src", "price": "p"}[grp]
            nexts[f"n_{grp}{rank}"] = next_match(_has(grp, rank), value)
    m = m.select("page_id", "url", "idx", "end", "m_card", *[c.alias(n) for n, c in nexts.items()])
    within = lambda n: F.col(f"{n}.at") < F.col("end")
    first = lambda n, value: F.when(within(n), F.col(f"{n}.{value}"))
    ranks = lambda grp: [f"n_{grp}{r}" for r in range(len(_CARD_GROUPS[grp]))]
    # the first title selector that matches decides; an empty title falls back to the first heading / link text
    title = F.coalesce(*[first(n, "text") for n in ranks("title")])
    name = F.coalesce(F.when(title != "", title), first("n_heading", "text"))
    image = F.coalesce(*[first(n, "src") for n in ranks("image")], first("n_img", "src"))
    price = F.coalesce(*[F.when(within(n) & (F.col(f"{n}.p.from_content") | (F.coalesce(F.col(f"{n}.p.price"), F.lit(0)) != 0)),
                                F.col(f"{n}.p")) for n in ranks("price")])
    card_ranks = F.array_compact(F.array(*[F.when(_has("card", r), F.lit(r)) for r in range(len(CARD_SELECTORS))]))
    cards = m.filter(F.col("m_card") != 0).select(
        "page_id", "url", F.explode(card_ranks).alias("card_rank"), F.col("idx").alias("card_idx"),
        F.when(F.coalesce(name, F.lit("")) != "", name).alias("name"), first("n_link", "href").alias("href"),
        image.alias("img"), price.alias("p"))
    # a card selector needs two elements and a name; the first such one wins
    per_rank, per_page = Window.partitionBy("page_id", "card_rank"), Window.partitionBy("page_id")
    cards = cards.withColumn("n", F.count(F.lit(1)).over(per_rank)).filter((F.col("n") >= 2) & F.col("name").isNotNull())
    cards = cards.withColumn("best", F.min("card_rank").over(per_page)).filter(F.col("card_rank") == F.col("best"))
    # the first currency element inside the price's parent
    parents = m.filter(within("n_cur")).select("page_id", F.col("idx").alias("p_parent"), F.col("n_cur.cur").alias("parent_currency"))
    out = cards.withColumn("p_parent", F.when(F.col("p.from_content"), F.col("p.parent"))).join(
        parents, ["page_id", "p_parent"], "left")
    return out.select(
        "page_id", "card_rank", "card_idx", "name", F.col("p.price").alias("price"),
        F.when(F.col("p.from_content"), F.coalesce(F.col("parent_currency"), F.lit("USD")))
         .otherwise(F.coalesce(F.col("p.text_currency"), F.lit("USD"))).alias("currency"),
        F.when(F.col("href").isNotNull(), url_join(F.col("url"), F.col("href"))).otherwise(F.lit("")).alias("product_url"),
        F.when(F.col("img").isNotNull(), url_join(F.col("url"), F.col("img"))).alias("image_url"),
        F.lit("custom").alias("platform"))


# --- J7: JSON-LD ---------------------------------------------------------------------------

_LD_RE = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def json_ld_products(pages: DataFrame) -> DataFrame:
    """Schema.org products from ``application/ld+json`` blocks: a list,
    a Product or an ItemList (items unwrapped from ``item``); name required;
    image string / list / object; offers object or list; priceCurrency
    defaults to USD.  Bad JSON yields nothing."""
    s = pages.select("page_id", F.col("url").alias("base"),
                     F.posexplode(F.regexp_extract_all("html", F.lit(_LD_RE), 1)).alias("block", "js"))
    v = F.try_parse_json("js")
    s = s.select("page_id", "base", "block", v.alias("v")).filter(F.col("v").isNotNull())
    typ = F.try_variant_get("v", "$['@type']", "string")
    items = (F.when(F.try_variant_get("v", "$", "array<variant>").isNotNull(), F.try_variant_get("v", "$", "array<variant>"))
             .when(typ == "Product", F.array(F.col("v")))
             .when(typ == "ItemList", F.coalesce(F.try_variant_get("v", "$.itemListElement", "array<variant>"), F.array()))
             .otherwise(F.array()))
    e = s.select("page_id", "base", "block", F.posexplode(items).alias("pos", "it"))
    it = F.coalesce(F.try_variant_get("it", "$.item", "variant"), F.col("it"))
    e = e.withColumn("it", it)
    name = F.try_variant_get("it", "$.name", "string")
    img = F.coalesce(F.try_variant_get("it", "$.image", "array<variant>"), F.array(F.try_variant_get("it", "$.image", "variant")))
    img0 = F.try_element_at(img, F.lit(1))
    img_s = F.coalesce(F.try_variant_get(img0, "$.url", "string"), F.try_variant_get(img0, "$", "string"))
    offers = F.coalesce(F.try_element_at(F.try_variant_get("it", "$.offers", "array<variant>"), F.lit(1)),
                        F.try_variant_get("it", "$.offers", "variant"))
    price_s = F.try_variant_get(offers, "$.price", "string")
    price = F.when(price_s.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$") & (price_s.try_cast("double") != 0),
                   F.trim(price_s).try_cast("decimal(18,4)"))
    url = F.try_variant_get("it", "$.url", "string")
    return (e.select("page_id", "block", "pos", name.alias("name"), price.alias("price"),
                     F.coalesce(F.try_variant_get(offers, "$.priceCurrency", "string"), F.lit("USD")).alias("currency"),
                     F.when(F.coalesce(img_s, F.lit("")) != "", img_s).alias("image_url"),
                     F.when(F.coalesce(url, F.lit("")) != "", url_join(F.col("base"), url)).otherwise(F.lit("")).alias("product_url"),
                     F.try_variant_get("it", "$.sku", "string").alias("sku"), F.lit("custom").alias("platform"))
            .filter(F.coalesce(F.col("name"), F.lit("")) != ""))


def generic_catalog(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """J6 then J7: cards when a card selector succeeds on the page, JSON-LD
    products otherwise."""
    # the cards feed two branches: found once, written, and read back
    cards = materialize(product_cards(pages, partitions), "product_cards")
    ld = json_ld_products(pages).join(cards.select("page_id").distinct(), "page_id", "left_anti")
    c = cards.select("page_id", F.col("card_idx").cast("bigint").alias("ordinal"), "name", "price", "currency",
                     "product_url", "image_url", F.lit(None).cast("string").alias("sku"), "platform",
                     F.lit("cards").alias("source"))
    j = ld.select("page_id", (F.shiftleft(F.col("block").cast("bigint"), 32) + F.col("pos")).alias("ordinal"), "name", "price",
                  "currency", "product_url", "image_url", "sku", "platform", F.lit("json_ld").alias("source"))
    return c.unionByName(j)
