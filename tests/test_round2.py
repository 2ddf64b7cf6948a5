"""Rules that the first round's data did not reach."""

import random
from datetime import datetime, timedelta
from decimal import Decimal
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pricelens import config as C
from pricelens.functions import text as TX
from pricelens.functions import url as U
from pricelens.operators import alerts as A
from pricelens.operators import html as HT
from pricelens.operators import maintenance as MT
from pricelens.operators.series import rank_within_buckets
from pricelens.sources import catalog as CT

BASE = datetime(2024, 1, 1)


def _replay(candidates, settings, existing, cap):
    """The application's rule, one candidate after the other."""
    count, out = dict(existing), {}
    for c in sorted(candidates, key=lambda c: (c["detected_at"], c["id"])):
        s, u, kind = settings.get(c["user_id"]), c["user_id"], c["alert_type"]
        n = count.get(u, 0)
        if kind != "currency_changed" and s:
            if not s[0]:
                out[c["id"]] = (False, A.MSG_EMAIL_OFF)
                continue
            if kind == "price_drop" and not s[1]:
                out[c["id"]] = (False, A.MSG_DROP_OFF)
                continue
            if kind == "price_increase" and not s[2]:
                out[c["id"]] = (False, A.MSG_INCREASE_OFF)
                continue
        if kind != "currency_changed" and n >= cap:
            out[c["id"]] = (False, f"User has too many pending alerts ({n})")
            continue
        count[u] = n + 1
        out[c["id"]] = (True, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_alert_cap_equals_a_replay(spark, seed):
    rnd = random.Random(seed)
    kinds = ["price_drop", "price_increase", "currency_changed"]
    cand = [{"id": i, "user_id": rnd.choice([0, 0, 0, 1, 2, 3, 4]), "alert_type": rnd.choice(kinds),
             "detected_at": BASE + timedelta(minutes=rnd.randint(0, 600)), "price_change_percent": Decimal("12.50"),
             "old_currency": "USD", "new_currency": "EUR"} for i in range(150)]
    settings = {0: (True, True, True), 1: (True, False, True), 2: (False, True, True), 3: (True, True, False)}
    existing = {0: 2, 1: 5, 2: 9, 4: 4}          # below, at and above the cap of 5
    schema = ("id int, user_id int, alert_type string, detected_at timestamp_ntz, price_change_percent decimal(12,2), "
              "old_currency string, new_currency string")
    cols = [c.split()[0] for c in schema.replace("(12,2)", "").split(", ")]
    c = spark.createDataFrame([tuple(r[k] for k in cols) for r in cand], schema)
    s = spark.createDataFrame([(u, *v, True) for u, v in settings.items()] + [(4, None, None, None, None)],
                              "user_id int, email_enabled boolean, alert_price_drop boolean, alert_price_increase boolean, has_settings boolean")
    p = spark.createDataFrame([(u, False) for u, n in existing.items() for _ in range(n)], "user_id int, included_in_digest boolean")
    got = {r.id: (r.alert_created, r.message) for r in A.alert_decision(c, s, p, cap=5).collect()}
    want = _replay(cand, settings, existing, 5)
    assert set(got) == set(want)
    for i, (created, message) in want.items():
        assert got[i][0] == created, i
        if message:
            assert got[i][1] == message, i


def test_links_like_urljoin(spark):
    bases = ["https://a.com", "https://a.com/", "https://a.com/x/y/", "https://a.com/1/2/3/4/5/6/p?q=1#f", "http://a.com/a//b/c"]
    hrefs = ["", "x", "./x", *("../" * n + "x" for n in range(1, 9)), "/x/../y", "/../x", "..", ".", "../", "?q", "#f",
             "//h/p", "a/./b/../../c?x=../y", "../a//b", "x/../../..", "/."]
    rows = [(b, h) for b in bases for h in hrefs]
    for r in spark.createDataFrame(rows, "b string, h string").select("b", "h", U.url_join(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.h), (r.b, r.h)


def test_strip_and_names(spark):
    df = spark.createDataFrame([("\thttps://a.com/x\n ", "plain"), ("  ", None), ("a.com", "x@y@z")], "u string, e string")
    got = df.select(U.normalise_url(F.col("u")).alias("n"), TX.user_name(F.col("e")).alias("name")).collect()
    assert [r.n.url for r in got] == ["https://a.com/x", None, "https://a.com"]
    assert [r.name for r in got] == ["plain", "User", "x"]


def test_repeated_patches_do_not_multiply_rows(spark):
    products = spark.createDataFrame([(1, "a", True, BASE), (2, "b", True, BASE)],
                                     "id int, product_name string, is_active boolean, updated_at timestamp_ntz")
    patch = spark.createDataFrame([(1, 1, "x", None), (1, 3, None, False), (1, 2, "y", True), (1, 1, "x", None)],
                                  "id int, seq int, product_name string, is_active boolean")
    out, errors = MT.update_products(products, patch, "2024-02-01 00:00:00", order="seq")
    assert sorted((r.id, r.product_name, r.is_active) for r in out.collect()) == [(1, "y", False), (2, "b", True)]
    assert errors.count() == 0
    gone = MT.soft_delete(products, spark.createDataFrame([(2,), (2,)], "id int"))
    assert sorted((r.id, r.is_active) for r in gone.collect()) == [(1, True), (2, False)]
    comp = spark.createDataFrame([(1, "USD")], "id int, expected_currency string")
    pend = spark.createDataFrame([(5, 1, "currency_changed", False)], "id int, competitor_id int, alert_type string, included_in_digest boolean")
    acc = spark.createDataFrame([(1, "EUR", 2), (1, "GBP", 1)], "competitor_id int, currency string, seq int")
    c, p = MT.accept_currency(comp, pend, acc, order="seq")
    assert [tuple(r) for r in c.collect()] == [(1, "EUR")] and [r.included_in_digest for r in p.collect()] == [True]


def test_price_that_does_not_fit_is_a_failed_row(spark):
    rows = spark.createDataFrame([(1, 1, Decimal("123456789.5"), "USD", BASE, "success", None), (2, 1, Decimal("99999999.99"), "USD", BASE, "success", None)],
                                 "id int, competitor_id int, price decimal(20,2), currency string, scraped_at timestamp_ntz, status string, error string")
    got = {r.id: r for r in MT.append_prices(rows, "2024-01-01 00:00:00").collect()}
    assert (got[1].price, got[1].scrape_status, got[1].error_message) == (None, "failed", C.PRICE_TOO_LARGE)
    assert got[2].price == Decimal("99999999.99") and got[2].scrape_status == "success"


def _elements(spark, html, key="int", page=1, **kw):
    pages = spark.createDataFrame([(page, html)], f"page_id {key}, html string")
    return {(r.idx, r.tag): r for r in HT.html_elements(pages, **kw).collect()}


def test_optional_end_tags(spark):
    got = _elements(spark, "<ul><li class=price>$5<li>desc 7<ul><li>in</ul>tail</ul><p>one<p>two<div>x</div>"
                           "<table><tr><td>a<td>b<tr><td>c</table><select><option>u<option>v</select><dl><dt>k<dd>w<dt>l</dl>")
    text = [(r.tag, r.text) for _, r in sorted(got.items())]
    assert text == [("ul", "$5desc 7intail"), ("li", "$5"), ("li", "desc 7intail"), ("ul", "in"), ("li", "in"), ("p", "one"),
                    ("p", "two"), ("div", "x"), ("table", "abc"), ("tr", "ab"), ("td", "a"), ("td", "b"), ("tr", "c"),
                    ("td", "c"), ("select", "uv"), ("option", "u"), ("option", "v"), ("dl", "kwl"), ("dt", "k"), ("dd", "w"),
                    ("dt", "l")]


def test_first_of_equal_attributes_and_any_page_key(spark):
    got = _elements(spark, '<b id=x id=y class="c d" class=e>t</b>', key="string", page="uuid-1")
    (r,) = got.values()
    assert (r.page_id, r.elem_id, r.classes, r.text) == ("uuid-1", "x", ["c", "d"], "t")


def test_only_wanted_elements_with_their_ancestors(spark):
    got = _elements(spark, "<div id=a><p class=q><span class=price>5</span></p><i>no</i></div>", wanted={"c:price"})
    (r,) = got.values()
    assert r.tag == "span" and [(a.tag, a.elem_id) for a in r.ancestors] == [("div", "a"), ("p", None)]


def test_large_page_is_reported_not_dropped(spark):
    pages = spark.createDataFrame([(1, "https://a.com/1", "<p class=price>$5</p>"), (2, "https://a.com/2", "<p class=price>$6</p>" + " " * 100)],
                                  "page_id int, url string, html string")
    targets = spark.createDataFrame([(1, "https://a.com/1"), (2, "https://a.com/2")], "competitor_id int, url string")
    assert {r.competitor_id: r.status for r in HT.scrape_result(targets, pages).collect()} == {1: "success", 2: "success"}
    cut = {r.competitor_id: r.error_message for r in HT.scrape_result(targets, pages, max_bytes=50).collect()}
    assert cut == {1: None, 2: "Page body exceeds 50 bytes"}


def test_json_ld_blocks_keep_their_order(spark):
    block = '<script type="application/ld+json">[{{"name": "p{0}"}}, {{"name": "q{0}"}}]</script>'
    page = "".join(block.format(i) for i in range(12))
    pages = spark.createDataFrame([(1, "https://a.com/", page), (2, "https://a.com/", page)], "page_id long, url string, html string")
    rows = CT.generic_html(pages).orderBy("page", "ordinal").collect()
    assert [r.name for r in rows] == [f"{c}{i}" for i in range(12) for c in "pq"] * 2


def test_all_rows_of_a_store_count_without_a_budget(spark):
    rows = [("s", p, i, f"w{p}-{i}") for p in range(30) for i in range(50)]
    cat = spark.createDataFrame([(*r, "t", [], "d") for r in rows],
                                "store string, page long, ordinal long, name string, product_type string, tags array<string>, description string")
    got = CT.fetch_filter_limit(cat, "w29-49", 5).collect()
    assert [(r.page, r.ordinal) for r in got] == [(29, 49)]
    assert CT.fetch_filter_limit(cat, "w29-49", 5, max_fetch=500).count() == 0
    assert CT.fetch_filter_limit(cat, None, 10_000, max_fetch=501).count() == 550       # whole pages


def test_rank_over_buckets_equals_a_plain_rank(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), BASE + timedelta(minutes=rnd.randint(0, 500)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id int")
    got = rank_within_buckets(df, "k", "t", [F.col("t").desc(), F.col("id").desc()], "pos").collect()
    for k in "ab":
        own = sorted(((r.t, r.id, r.pos) for r in got if r.k == k), reverse=True)
        assert [p for *_, p in own] == list(range(1, len(own) + 1))


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def __init__(self, d):
            self.d = d

        def get(self, k, default=None):
            return self.d.get(k, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.ensure_checkpoint_dir(Session())


def test_constraint_rows(spark):
    t = {
        "price_history": spark.createDataFrame([(1, 1, "success"), (2, 9, "odd")], "id int, competitor_id int, scrape_status string"),
        "insights": spark.createDataFrame([(1, "x", 2.0)], "id int, insight_type string, confidence_score double"),
        "pending_alerts": spark.createDataFrame([(1, "price_drop")], "id int, alert_type string"),
        "alert_history": spark.createDataFrame([(1, "sent")], "id int, email_status string"),
        "competitors": spark.createDataFrame([(1, 1, 5.0)], "id int, product_id int, alert_threshold_percent double"),
        "products": spark.createDataFrame([(1,)], "id int"),
        "tracking_jobs": spark.createDataFrame([(4, "stuck"), (5, "failed")], "id int, status string"),
        "user_alert_settings": spark.createDataFrame([(3,), (3,)], "user_id int"),
    }
    got = sorted((r.rule, r.key) for r in MT.constraint_violations(t).collect())
    assert got == [("insights.confidence_score", "1"), ("insights.insight_type", "1"), ("price_history.competitor_id_fk", "2"),
                   ("price_history.scrape_status", "2"), ("tracking_jobs.status", "4"), ("user_alert_settings.user_id_unique", "3")]
    assert {r.rule: r.violations for r in MT.constraint_report(t).collect()}["alert_history.email_status"] == 0
