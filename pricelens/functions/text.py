"""Text scalars (B5, H7-H9, H11, H12, H14-H16, I7, I8) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# fixed values: patterns the application deletes after HTML-escaping
INSIGHT_DANGEROUS = ["<script", "javascript:", "SELECT ", "DROP ", "INSERT ", "UPDATE ", "DELETE "]
MAIL_DANGEROUS = ["javascript:", "<script", "onerror=", "onclick="]
MAIL_SUBJECT_MAX = 200
MAIL_PRODUCT_NAME_MAX = 150
MAIL_USER_NAME_MAX = 100
MAIL_TEXT_MAX = 500
SUBJECT_PREFIX = "Price Alert: "   # brand prefix of the subject line; configurable


def py_strip(c: Column) -> Column:
    """Unicode white space off both ends, as Python's ``strip``."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _truncate(c: Column, max_len: int) -> Column:
    return F.when(F.char_length(c) > max_len, F.concat(F.substring(c, 1, max_len - 3), F.lit("..."))).otherwise(c)


def escape_name(name: Column) -> Column:
    """H7: trim, '<' -> '&lt;', '>' -> '&gt;'."""
    return F.replace(F.replace(py_strip(name), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sanitize_insight(text: Column) -> Column:
    """H8: escape '<' '>', delete the dangerous patterns (case-sensitive), trim;
    over 500 characters -> first 497 + '...'."""
    t = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for p in INSIGHT_DANGEROUS:
        t = F.replace(t, F.lit(p), F.lit(""))
    return _truncate(py_strip(t), C.MAX_INSIGHT_TEXT)


def sanitize_mail(text: Column, max_length: int = MAIL_TEXT_MAX) -> Column:
    """H9: null/empty -> ''; trim; escape & < > \" '; delete script patterns;
    truncate to ``max_length`` with '...'."""
    t = py_strip(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    for p in MAIL_DANGEROUS:
        t = F.replace(t, F.lit(p), F.lit(""))
    return F.when(text.isNull() | (text == ""), F.lit("")).otherwise(_truncate(t, max_length))


def clean_email(email: Column) -> Column:
    """struct(email, error): trim + lower; invalid without '@' or '.', or
    with CR/LF."""
    e = F.lower(py_strip(email))
    err = (F.when((F.instr(e, "@") == 0) | (F.instr(e, ".") == 0), F.concat(F.lit("Invalid email address: "), e))
           .when(e.rlike("[\\r\\n]"), F.lit("Email address contains invalid characters")))
    return F.struct(F.when(err.isNull(), e).alias("email"), err.alias("error"))


def user_name(email: Column) -> Column:
    """Text before the first '@' (all of it without one); 'User' for null
    or empty."""
    return F.when(email.isNull() | (email == ""), F.lit("User")).otherwise(F.substring_index(email, "@", 1))


def truncate_error(err: Column, n: int = C.ERROR_TEXT_MAX) -> Column:
    """First ``n`` characters."""
    return F.left(err, F.lit(n))


def digest_subject(drops: Column, increases: Column) -> Column:
    """H15: 'N price drop(s) & M price increase(s)' (zero parts omitted),
    prefixed, mail-sanitised (so '&' becomes '&amp;'), at most 200 chars."""
    d = F.when(drops > 0, F.concat(drops.cast("string"), F.lit(" price drop"), F.when(drops > 1, F.lit("s")).otherwise(F.lit(""))))
    i = F.when(increases > 0, F.concat(increases.cast("string"), F.lit(" price increase"),
                                        F.when(increases > 1, F.lit("s")).otherwise(F.lit(""))))
    raw = F.concat(F.lit(SUBJECT_PREFIX), F.concat_ws(" & ", d, i))
    return sanitize_mail(raw, MAIL_SUBJECT_MAX)


def digest_line(n: Column, product_name: Column, store: Column, alert_type: Column, pct: Column,
                old_price: Column, new_price: Column, currency: Column) -> Column:
    """One plain-text digest entry (arrow down only for price drops)."""
    arrow = F.when(alert_type == "price_drop", F.lit("↓")).otherwise(F.lit("↑"))
    return F.concat(
        n.cast("string"), F.lit(". "), sanitize_mail(F.coalesce(product_name, F.lit("Unknown Product")), MAIL_PRODUCT_NAME_MAX),
        F.lit("\n   Store: "), sanitize_mail(F.coalesce(store, F.lit("Unknown Competitor"))),
        F.lit("\n   Change: "), arrow, F.lit(" "),
        fmt_decimal(F.abs(F.coalesce(pct, F.lit(0))), 1), F.lit("%"),
        F.lit("\n   Price: "), currency, F.lit(" "), fmt_decimal(F.coalesce(old_price, F.lit(0)), 2),
        F.lit(" → "), currency, F.lit(" "), fmt_decimal(F.coalesce(new_price, F.lit(0)), 2))


def fmt_decimal(x: Column, digits: int) -> Column:
    """Fixed-point text of a decimal, rounded half-even on the exact decimal
    value (the application formats binary floats; the two differ only on
    exact .x5 ties)."""
    return F.bround(x.cast("decimal(30,10)"), digits).cast(f"decimal(30,{digits})").cast("string")


def keyword_match(text_cols: list[Column], keyword: str | None) -> Column:
    """Case-insensitive; the keyword is split on whitespace and a row is
    kept if any word is a substring of name + type + tags + description.  A
    blank keyword keeps everything."""
    if keyword is None or not keyword.strip():
        return F.lit(True)
    words = [w.lower() for w in keyword.split()]
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in text_cols]))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(hay, w) > 0)


def insight_type(t: Column) -> Column:
    """I8: lower-cased; anything else than the three types -> 'pattern'."""
    lt = F.lower(F.coalesce(t, F.lit("")))
    return F.when(lt.isin(*C.INSIGHT_TYPES), lt).otherwise(F.lit("pattern"))


def confidence(raw: Column) -> Column:
    """Numeric in [0, 1] -> rounded to 2 decimals; otherwise 0.5."""
    t = F.lower(F.trim(raw.cast("string")))
    # a JSON boolean converts like float(True) / float(False)
    v = F.when(t == "true", F.lit(1.0)).when(t == "false", F.lit(0.0)).otherwise(t.try_cast("double"))
    ok = v.isNotNull() & (v >= 0) & (v <= 1) & ~F.isnan(v)
    return F.when(ok, F.round(v.cast("decimal(20,10)"), 2)).otherwise(F.lit(0.5)).cast("decimal(3,2)")
