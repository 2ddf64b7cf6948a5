"""Money scalars as native Column expressions.

No Python UDF: everything stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s misses NBSP and other Unicode spaces; (?U) makes it Unicode-aware
# like Python's re on str.
_WS = r"(?U)\s"

# fixed values: currency symbols of the money formatter (code -> symbol)
CURRENCY_SYMBOLS = {
    "NGN": "₦", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥", "INR": "₹", "KRW": "₩",
    "BRL": "R$", "CAD": "CA$", "AUD": "A$", "ZAR": "R", "GHS": "GH₵", "KES": "KSh", "AED": "د.إ",
    "SAR": "﷼", "MXN": "MX$", "PHP": "₱", "THB": "฿", "VND": "₫", "PLN": "zł", "SEK": "kr",
    "NOK": "kr", "DKK": "kr", "CHF": "CHF",
}


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _european(cleaned: Column) -> Column:
    """Locale mode: 1.234,56 -> 1234.56; 12,50 -> 12.50; 1,234 -> 1234."""
    last_c = F.length(cleaned) - F.locate(",", F.reverse(cleaned)) + 1
    last_d = F.length(cleaned) - F.locate(".", F.reverse(cleaned)) + 1
    has_c = F.instr(cleaned, ",") > 0
    has_d = F.instr(cleaned, ".") > 0
    tail_len = F.length(F.substring_index(cleaned, ",", -1))
    return (F.when(has_c & has_d & (last_c > last_d),
                   F.regexp_replace(F.regexp_replace(cleaned, r"\.", ""), ",", "."))
            .when(has_c & ~has_d & (tail_len == 2), F.regexp_replace(cleaned, ",", "."))
            .when(has_c & ~has_d, F.regexp_replace(cleaned, ",", ""))
            .otherwise(cleaned))


def parse_price(text: Column, mode: str = "reference", scale: int = 4) -> Column:
    """H1: text -> struct(price decimal(18,scale), currency).

    Currency: '₦' or 'NGN' (any case) -> NGN, '£' GBP, '€' EUR, 'CAD'/'C$' CAD,
    else USD.  Symbols, commas, whitespace and ASCII letters are deleted and the
    rest parsed as a decimal (null when it does not parse; currency is kept).
    In ``reference`` mode commas are deleted before any locale handling (so
    '€1.234,56' -> 1.2346); ``locale`` mode implements the documented intent
    (1234.56)."""
    t = _strip(text)
    cur = (F.when(F.instr(t, "₦") > 0, F.lit("NGN"))
           .when(F.instr(F.upper(t), "NGN") > 0, F.lit("NGN"))
           .when(F.instr(t, "£") > 0, F.lit("GBP"))
           .when(F.instr(t, "€") > 0, F.lit("EUR"))
           .when((F.instr(t, "CAD") > 0) | (F.instr(t, "C$") > 0), F.lit("CAD"))
           .otherwise(F.lit("USD")))
    if mode == "reference":
        cleaned = F.regexp_replace(F.regexp_replace(t, r"(?U)[£€$₦,\s]", ""), "[A-Za-z]", "")
    elif mode == "locale":
        cleaned = _european(F.regexp_replace(F.regexp_replace(t, r"(?U)[£€$₦\s]", ""), "[A-Za-z]", ""))
    else:
        raise ValueError(mode)
    price = _to_decimal(cleaned, scale)
    empty = text.isNull() | (text == "")
    return F.struct(F.when(~empty, price).alias("price"),
                    F.when(empty, F.lit("USD")).otherwise(cur).alias("currency"))


def _to_decimal(s: Column, scale: int) -> Column:
    # only plain decimal literals parse (Python's Decimal would accept a few
    # more spellings, none of which survive the letter/symbol removal)
    ok = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    return F.when(ok, s.try_cast(f"decimal(18,{scale})"))


def parse_price_catalog(text: Column, scale: int = 4) -> Column:
    """H2: catalog-card variant: £ GBP, € EUR, ¥ JPY, ₹ INR, else USD; no NGN/CAD
    and no trimming (whitespace is deleted anyway)."""
    cur = (F.when(F.instr(text, "£") > 0, F.lit("GBP"))
           .when(F.instr(text, "€") > 0, F.lit("EUR"))
           .when(F.instr(text, "¥") > 0, F.lit("JPY"))
           .when(F.instr(text, "₹") > 0, F.lit("INR"))
           .otherwise(F.lit("USD")))
    cleaned = F.regexp_replace(F.regexp_replace(text, r"(?U)[£€$¥₹,\s]", ""), "[A-Za-z]", "")
    empty = text.isNull() | (text == "")
    return F.struct(F.when(~empty, _to_decimal(cleaned, scale)).alias("price"),
                    F.when(empty, F.lit("USD")).otherwise(cur).alias("currency"))


def minor_units(amount: Column, minor_unit: Column) -> Column:
    """H3: integer string in minor units / 10^n (n defaults to 2) as decimal."""
    n = F.coalesce(minor_unit, F.lit(2))
    a = amount.try_cast("decimal(38,0)")
    return (a / F.pow(F.lit(10), n).cast("decimal(38,0)")).cast("decimal(18,4)")


def format_money(price: Column, currency: Column) -> Column:
    """Symbol (fallback 'CODE ') + amount with 2 decimals and thousands
    separators; falsy price -> 'Price N/A'."""
    m = F.create_map(*[F.lit(x) for kv in CURRENCY_SYMBOLS.items() for x in kv])
    sym = F.coalesce(F.try_element_at(m, currency), F.concat(currency, F.lit(" ")))
    return F.when(price.isNull() | (price == 0), F.lit("Price N/A")).otherwise(
        F.concat(sym, F.format_number(price.cast("double"), 2)))


def format_signed_pct(pct: Column, is_drop: Column) -> Column:
    """I9: '-' for drops else '+', absolute value with one decimal; empty when
    the percent is null or zero (dashboard rendering)."""
    from .text import fmt_decimal
    txt = F.concat(F.when(is_drop, F.lit("-")).otherwise(F.lit("+")), fmt_decimal(F.abs(pct), 1), F.lit("%"))
    return F.when(pct.isNull() | (pct == 0), F.lit("")).otherwise(txt)
