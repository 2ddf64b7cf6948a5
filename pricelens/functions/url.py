"""URL scalars (B14, B15, H4, H5, H6, H10, H17, H18) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# fixed values: SSRF rules of the scraper (hostname patterns, metadata hosts,
# internal suffixes), in the order the reference lists them
BLOCKED_HOST_PATTERNS = [
    r"^localhost$", r"^127\.", r"^10\.", r"^172\.(1[6-9]|2[0-9]|3[01])\.", r"^192\.168\.", r"^0\.",
    r"^169\.254\.", r"^::1$", r"^fc[0-9a-f]{2}:", r"^fd[0-9a-f]{2}:", r"^fe80:",
]
BLOCKED_HOSTS = ["169.254.169.254", "metadata.google.internal"]
BLOCKED_SUFFIXES = [".local", ".localhost", ".internal", ".corp", ".lan", ".home", ".intranet"]

ERR_EMPTY = "URL cannot be empty"
ERR_HTTP = ("HTTP is not secure. Please use the HTTPS version of this URL "
            "(replace http:// with https://)")
ERR_FORMAT = "Invalid URL format. Please enter a valid product URL"
ERR_SCHEME = "Only HTTPS URLs are allowed"
ERR_PRIVATE = "Private or internal URLs are not allowed"

_SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_NETLOC_RE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME_RE, 1))


def netloc(url: Column) -> Column:
    """Authority part of an absolute URL ('' when there is none), as Python's
    urlparse(...).netloc."""
    return F.regexp_extract(url, _NETLOC_RE, 1)


def hostname(url: Column) -> Column:
    """Lower-cased host without user info, port or IPv6 brackets."""
    n = F.regexp_replace(netloc(url), r"^.*@", "")
    v6 = F.regexp_extract(n, r"^\[([^\]]*)\]", 1)
    host = F.when(n.startswith("["), v6).otherwise(F.regexp_replace(n, r":[^:]*$", ""))
    return F.lower(host)


def normalise_url(url: Column) -> Column:
    """struct(url, error): white space of any kind trimmed; empty -> error; http:// (any case)
    rejected; without 'https://' (case-sensitive) the text is prefixed when it
    has a '.' and no space, else an error."""
    u = py_strip(url)
    err = (F.when(u.isNull() | (u == ""), F.lit(ERR_EMPTY))
           .when(F.lower(u).startswith("http://"), F.lit(ERR_HTTP))
           .when(~u.startswith("https://") & ~((F.instr(u, ".") > 0) & (F.instr(u, " ") == 0)), F.lit(ERR_FORMAT)))
    fixed = F.when(u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.struct(F.when(err.isNull(), fixed).alias("url"), err.alias("error"))


def url_safety(url: Column) -> Column:
    """struct(ok, error): https only; private, loopback, link-local and
    metadata hosts and internal suffixes are blocked."""
    h = hostname(url)
    pat = "|".join(f"({p})" for p in BLOCKED_HOST_PATTERNS)
    suffix = "(" + "|".join(s.replace(".", r"\.") for s in BLOCKED_SUFFIXES) + ")$"
    err = (F.when(scheme(url) != "https", F.lit(ERR_SCHEME))
           .when(h.rlike(pat) | h.isin(*BLOCKED_HOSTS) | h.rlike(suffix), F.lit(ERR_PRIVATE)))
    return F.struct(err.isNull().alias("ok"), err.alias("error"))


def domain_of(url: Column, variant: str = "strip") -> Column:
    """H4: the six domain spellings used by the application.

    netloc    - authority as is
    strip     - leading 'www.' removed
    export    - lower-cased, leading 'www.' removed, '' -> 'Unknown'
    no_www    - every 'www.' removed
    lower     - lower-cased, leading 'www.' removed
    hostname  - browser hostname: lower-cased, no port, first 'www.' removed
    """
    n = netloc(url)
    if variant == "netloc":
        return n
    if variant == "strip":
        return F.regexp_replace(n, r"^www\.", "")
    if variant == "lower":
        return F.regexp_replace(F.lower(n), r"^www\.", "")
    if variant == "export":
        d = F.regexp_replace(F.lower(n), r"^www\.", "")
        return F.when(d == "", F.lit("Unknown")).otherwise(d)
    if variant == "no_www":
        return F.replace(n, F.lit("www."), F.lit(""))
    if variant == "hostname":
        h = hostname(url)
        return F.when(h == "", url).otherwise(F.regexp_replace(h, r"^(.*?)www\.", "$1"))
    raise ValueError(variant)


def retailer_or_domain(retailer_name: Column, url: Column, variant: str = "strip") -> Column:
    """H5: retailer name, else (also for '') the domain."""
    return F.coalesce(F.when(retailer_name != "", retailer_name), domain_of(url, variant))


def _fold_dots(segments: Column) -> Column:
    """The path of some segments, '.' and '..' resolved however many there are."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(segments, none, lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
                       .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    path = F.array_join(F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def url_join(base: Column, href: Column) -> Column:
    """H6: resolve a link against the page URL like ``urljoin``: absolute,
    scheme-relative, root-relative, query-only, fragment-only and
    path-relative references, any number of '.' and '..' segments."""
    b_scheme = F.regexp_extract(base, _SCHEME_RE, 1)
    b_origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    b_nofrag = F.regexp_extract(base, r"^([^#]*)", 1)
    b_path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    h_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    h_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    own = F.split(h_path, "/")
    # the base without its last segment, then the link's; empty segments in between go
    parts = F.split(b_path, "/")
    parts = F.when(F.element_at(parts, -1) != "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    both = F.concat(parts, own)
    n = F.size(both)
    middle = F.filter(F.slice(both, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    both = F.when(n > 2, F.concat(F.slice(both, 1, 1), middle, F.slice(both, -1, 1))).otherwise(both)
    # most links have no '.' or empty segments to resolve and are just put together
    b_dir = F.regexp_replace(b_path, r"[^/]*$", "")
    b_dir = F.when(b_dir == "", F.lit("/")).otherwise(b_dir)
    plain_root = href.startswith("/") & ~h_path.contains("/.")
    joined = F.concat(b_dir, h_path)
    plain = ~joined.contains("/.") & ~joined.contains("//")
    return (F.when(href.isNull() | (href == ""), base)
            .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(b_scheme, F.lit(":"), href))
            .when(plain_root, F.concat(b_origin, href))
            .when(href.startswith("/"), F.concat(b_origin, _fold_dots(own), h_rest))
            .when(href.startswith("?"), F.concat(b_origin, b_path, href))
            .when(href.startswith("#"), F.concat(b_nofrag, href))
            .when(plain, F.concat(b_origin, joined, h_rest))
            .otherwise(F.concat(b_origin, _fold_dots(both), h_rest)))


def safe_filename(name: Column) -> Column:
    """Characters other than letters, digits, '.', '_', '-', ' ' become '_'."""
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}._ \-]", "_"))


def export_filename(product_name: Column, as_of_date: Column) -> Column:
    return F.concat(safe_filename(product_name), F.lit("_price_history_"),
                    F.date_format(as_of_date, "yyyyMMdd"), F.lit(".csv"))


def platform_of_html(html: Column) -> Column:
    """H17: 'shopify' / 'woocommerce' / null from page text."""
    h = F.lower(html)
    return (F.when(F.instr(h, "shopify") > 0, F.lit("shopify"))
            .when((F.instr(h, "woocommerce") > 0) | (F.instr(h, "wc-block") > 0), F.lit("woocommerce")))


def platform_of_payload(body: Column, url: Column) -> Column:
    """Platform of a landed response: JSON object with 'products' ->
    shopify; non-empty JSON array -> woocommerce; page with Shopify markers ->
    shopify; any https URL with a host -> custom."""
    j = F.try_parse_json(body)
    kind = F.schema_of_variant(j)
    is_obj_products = F.try_variant_get(j, "$.products", "string").isNotNull()
    is_array = kind.startswith("ARRAY") & (F.try_variant_get(j, "$[0]", "string").isNotNull())
    shop_html = (F.instr(body, "cdn.shopify") > 0) | (F.instr(body, "Shopify.theme") > 0)
    return (F.when(j.isNotNull() & is_obj_products, F.lit("shopify"))
            .when(j.isNotNull() & is_array, F.lit("woocommerce"))
            .when(shop_html, F.lit("shopify"))
            .when((scheme(url) == "https") & (hostname(url) != ""), F.lit("custom")))
