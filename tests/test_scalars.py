"""Scalar operators against the edge values of FIXTURES.md §4."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricelens.functions import price as P
from pricelens.functions import text as TX
from pricelens.functions import timefmt as TF
from pricelens.functions import url as U
from pricelens.operators.alerts import classify_change


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("text,price,cur", [
    ("$1,234.56", Decimal("1234.56"), "USD"),
    ("₦45,000", Decimal("45000"), "NGN"),
    ("C$ 9.99", Decimal("9.99"), "CAD"),
    ("€1.234,56", Decimal("1.2346"), "EUR"),
    ("12,50 €", Decimal("1250"), "EUR"),
    ("from $10 - $20", None, "USD"),
    ("Rs. 5", Decimal("0.5"), "USD"),
    ("", None, "USD"),
    ("$1 234.00", Decimal("1234.00"), "USD"),
    ("45 ngn", Decimal("45"), "NGN"),
    ("£3", Decimal("3"), "GBP"),
])
def test_parse_price_reference(spark, text, price, cur):
    r = one(spark, P.parse_price(F.col("x")), text)
    assert r["currency"] == cur
    assert (r["price"] is None and price is None) or r["price"] == price


def test_parse_price_locale(spark):
    assert one(spark, P.parse_price(F.col("x"), mode="locale"), "€1.234,56")["price"] == Decimal("1234.56")
    assert one(spark, P.parse_price(F.col("x"), mode="locale"), "12,50 €")["price"] == Decimal("12.50")
    assert one(spark, P.parse_price(F.col("x"), mode="locale"), "1,234")["price"] == Decimal("1234")


def test_parse_price_catalog(spark):
    r = one(spark, P.parse_price_catalog(F.col("x")), "¥1,200")
    assert r["price"] == Decimal("1200") and r["currency"] == "JPY"
    assert one(spark, P.parse_price_catalog(F.col("x")), "₹99")["currency"] == "INR"


def test_domain_variants(spark):
    url = "https://www.Shop.com:8443/p?q=1"
    assert one(spark, U.domain_of(F.col("x"), "netloc"), url) == "www.Shop.com:8443"
    assert one(spark, U.domain_of(F.col("x"), "strip"), url) == "Shop.com:8443"
    assert one(spark, U.domain_of(F.col("x"), "lower"), url) == "shop.com:8443"
    assert one(spark, U.domain_of(F.col("x"), "hostname"), url) == "shop.com"
    assert one(spark, U.domain_of(F.col("x"), "export"), "nourl") == "Unknown"
    assert one(spark, U.domain_of(F.col("x"), "no_www"), "https://www.a.www.b.com/") == "a.b.com"


@pytest.mark.parametrize("raw,url,err", [
    (" shop.com/x ", "https://shop.com/x", None),
    ("http://a.com", None, U.ERR_HTTP),
    ("HTTP://a.com", None, U.ERR_HTTP),
    ("foo", None, U.ERR_FORMAT),
    ("", None, U.ERR_EMPTY),
    ("https://a.com", "https://a.com", None),
])
def test_url_normalise(spark, raw, url, err):
    r = one(spark, U.normalise_url(F.col("x")), raw)
    assert r["url"] == url and r["error"] == err


@pytest.mark.parametrize("url,ok", [
    ("https://10.0.0.1", False), ("https://172.20.1.1", False), ("https://x.internal", False),
    ("https://localhost", False), ("https://172.32.0.1", True), ("https://a.com", True),
    ("http://a.com", False), ("https://169.254.169.254/latest", False), ("https://user@192.168.1.1:80/", False),
    ("https://[::1]/", False), ("https://shop.home", False),
])
def test_url_safety(spark, url, ok):
    assert one(spark, U.url_safety(F.col("x")), url)["ok"] is ok


@pytest.mark.parametrize("old,new,oc,nc,thr,kind", [
    ("100", "90", "USD", "USD", "10", "price_drop"),
    ("100", "110", "USD", "USD", "10", "price_increase"),
    ("100", "105", "USD", "USD", "10", "price_increase"),
    ("10", "10.5", "USD", "USD", "10", None),
    ("0", "5", "USD", "USD", "10", None),
    ("100", "100", "USD", "EUR", "10", "currency_changed"),
    (None, "100", None, "USD", "10", None),
    ("100", "100", "USD", "USD", "0", "price_drop"),
    ("99.99", "89.99", "USD", "USD", "10.00", "price_drop"),
])
def test_classify_change(spark, old, new, oc, nc, thr, kind):
    df = spark.createDataFrame([(old, new, oc, nc, thr)], "o string, n string, oc string, nc string, t string")
    c = classify_change(F.col("o").cast("decimal(10,2)"), F.col("n").cast("decimal(10,2)"), F.col("oc"), F.col("nc"),
                        F.col("t").cast("decimal(5,2)"))
    assert df.select(c.alias("k")).first()["k"] == kind


def test_text_sanitisers(spark):
    assert one(spark, TX.escape_name(F.col("x")), "  <b>Name</b> ") == "&lt;b&gt;Name&lt;/b&gt;"
    assert one(spark, TX.sanitize_insight(F.col("x")), " <script>SELECT x DROP y") == "&lt;script&gt;x y"
    assert one(spark, TX.sanitize_insight(F.col("x")), "a" * 600) == "a" * 497 + "..."
    assert one(spark, TX.sanitize_mail(F.col("x"), 10), "Tom & 'Jerry'") == "Tom &am..."
    assert one(spark, TX.sanitize_mail(F.col("x")), None) == ""
    assert one(spark, TX.clean_email(F.col("x")), " A@B.COM ")["email"] == "a@b.com"
    assert one(spark, TX.clean_email(F.col("x")), "nope")["email"] is None
    assert one(spark, TX.user_name(F.col("x")), "jane@x.org") == "jane"
    assert one(spark, TX.user_name(F.col("x")), "jane") == "jane"          # no "@": the whole text


def test_subject_and_line(spark):
    df = spark.createDataFrame([(2, 1), (1, 0), (0, 3)], "d int, i int")
    got = [r[0] for r in df.select(TX.digest_subject(F.col("d"), F.col("i"))).collect()]
    assert got == ["Price Alert: 2 price drops &amp; 1 price increase", "Price Alert: 1 price drop",
                   "Price Alert: 3 price increases"]
    line = one(spark, TX.digest_line(F.lit(1), F.lit("Kettle"), F.lit("Shop"), F.lit("price_drop"),
                                     F.lit(Decimal("-10.25")), F.lit(Decimal("99.99")), F.lit(Decimal("89.99")),
                                     F.lit("USD")), None)
    assert line == "1. Kettle\n   Store: Shop\n   Change: ↓ 10.2%\n   Price: USD 99.99 → USD 89.99"


def test_money_and_pct(spark):
    assert one(spark, P.format_money(F.col("x").cast("decimal(10,2)"), F.lit("EUR")), "1234.5") == "€1,234.50"
    assert one(spark, P.format_money(F.col("x").cast("decimal(10,2)"), F.lit("XYZ")), "3") == "XYZ 3.00"
    assert one(spark, P.format_money(F.col("x").cast("decimal(10,2)"), F.lit("USD")), "0") == "Price N/A"
    assert one(spark, P.format_signed_pct(F.col("x").cast("decimal(12,2)"), F.lit(True)), "-12.25") == "-12.2%"


def test_time_helpers(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    cases = {"2024-01-30 23:59:30": "Just now", "2024-01-30 23:15:00": "45m ago", "2024-01-30 20:00:00": "4h ago",
             "2024-01-28 00:00:00": "3d ago", "2024-01-01 00:00:00": "1/1/2024"}
    for ts, want in cases.items():
        assert one(spark, TF.time_ago(F.col("x").cast("timestamp_ntz"), now), ts) == want
    r = one(spark, TF.split_datetime(F.col("x")), "2024-01-15T10:00:00Z")
    assert (r["date"], r["time"]) == ("2024-01-15", "10:00:00")
    r = one(spark, TF.split_datetime(F.col("x")), "2024-01-15T23:30:05.123+02:00")
    assert (r["date"], r["time"]) == ("2024-01-15", "23:30:05")
    r = one(spark, TF.split_datetime(F.col("x")), "junk")
    assert (r["date"], r["time"]) == ("junk", "")
    r = one(spark, TF.split_datetime(F.col("x")), "")
    assert (r["date"], r["time"]) == ("", "")


def test_insight_validation_scalars(spark):
    assert one(spark, TX.confidence(F.col("x")), "1.5") == Decimal("0.50")
    assert one(spark, TX.confidence(F.col("x")), "x") == Decimal("0.50")
    assert one(spark, TX.confidence(F.col("x")), "0.834") == Decimal("0.83")
    assert one(spark, TX.confidence(F.col("x")), "true") == Decimal("1.00")
    assert one(spark, TX.insight_type(F.col("x")), "ALERT") == "alert"
    assert one(spark, TX.insight_type(F.col("x")), "trend") == "pattern"


def test_url_join(spark):
    from urllib.parse import urljoin
    cases = [("https://a.com", "x"), ("https://a.com/p/q", "x"), ("https://a.com/p/", "x"),
             ("https://a.com/c/?page=2", "x"), ("https://a.com/p?q", "?z"), ("https://a.com/p#f", "#g"),
             ("https://a.com/p", "//b.com/x"), ("https://a.com/p", "/x"), ("https://a.com/p", "./x"),
             ("https://a.com/a/b", "../x"), ("https://a.com/a/b/c", "../../x/y"), ("https://a.com/p", "https://z.org/"),
             ("https://a.com/p", "")]
    df = spark.createDataFrame(cases, "b string, h string")
    got = [r[0] for r in df.select(U.url_join(F.col("b"), F.col("h"))).collect()]
    assert got == [urljoin(b, h) for b, h in cases]
