"""Text: matching forms, aliases, masks, tokens and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded for matching, and their plain forms.
TURKISH, ASCII = "çÇğĞıİöÖşŞüÜ", "cCgGiIoOsSuU"
# Further Latin letters with marks, folded as decomposition would.
MARKED, PLAIN = "àáâãäåèéêëìíîïñòóôõùúûýÿ", "aaaaaaeeeeiiiinoooouuuyy"

# What each word of an input counts as.
PAYMENT_STATUS = {
    "paid": ("paid", "odendi", "odenmis", "closed", "kapandi"),
    "unpaid": ("unpaid", "odenmedi", "acik", "open"),
    "partial": ("partial", "partially_paid", "kismi", "kismen_odendi"),
}
LEDGER_DIRECTION = {
    "income": ("income", "inflow", "gelir", "giris", "tahsilat", "sale", "sales"),
    "expense": ("expense", "outflow", "gider", "cikis", "odeme", "purchase"),
}
DEBT_DIRECTION = {
    "receivable": ("receivable", "alacak", "income", "credit", "customer"),
    "debt": ("debt", "borc", "expense", "debit", "payable", "supplier"),
}
PARTY_TYPE = {"customer": ("customer", "musteri", "müşteri"), "supplier": ("supplier", "vendor", "tedarikci", "tedarikçi")}
SALES_TYPE = {
    "sale": ("sale", "sales", "satis"),
    "refund": ("refund", "return", "iade", "credit_note"),
    "exchange": ("exchange",),
    "partial_refund": ("partial_refund", "partial_return"),
    "correction": ("correction",),
}
VAT_TYPE = {"sale": ("sale", "sales", "satis", "output"), "purchase": ("purchase", "alis", "buy", "input")}
TAX_TYPE = {"KDV": ("kdv",), "Stopaj": ("stopaj",), "Gelir Vergisi": ("gelir vergisi",), "Kurumlar Vergisi": ("kurumlar vergisi",)}
STOCK_TYPE = {"stock_in": ("stock_in", "giris", "stok giris", "in"), "stock_out": ("stock_out", "cikis", "stok cikis", "out")}
TRUTHY = ("1", "true", "evet", "yes", "x")
ACTIVITY = {
    "operating": ("operating", "operasyon", "satis", "musteri", "maas", "kira", "vergi", "tedarikci", "hizmet", "personel"),
    "investing": ("investment", "yatirim", "duran varlik", "ekipman", "sunucu", "lisans", "varlik alimi"),
    "financing": ("financing", "finansman", "kredi", "sermaye", "yatirimci", "faiz", "borc"),
}
CATEGORY_WORDS = {"Kira": ("kira",), "Personel": ("maas", "personel"), "Pazarlama": ("reklam", "pazarlama"), "Yazilim": ("yazilim",), "Satis": ("satis",)}
LAW_ALIASES = {"VUK": "VERGI USUL KANUNU", "TCK": "TURK CEZA KANUNU", "TTK": "TURK TICARET KANUNU", "KVKK": "KISISEL VERILERIN KORUNMASI KANUNU"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def fold(c: Column) -> Column:
    """Turkish letters plain, before any change of case."""
    return F.translate(c, TURKISH, ASCII)


def match_form(c: Column) -> Column:
    """Lower case, marks off, all else than letters and digits as single spaces; null as empty."""
    low = F.translate(F.lower(fold(F.trim(F.coalesce(c, F.lit(""))))), MARKED, PLAIN)
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def upper_form(c: Column) -> Column:
    """The form that law names are compared in."""
    return F.upper(F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^0-9A-Za-z]+", " ")))


def law_name(c: Column) -> Column:
    return full_law_name(upper_form(c))


def full_law_name(name: Column) -> Column:
    """A name in upper_form by its alias, else as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LAW_ALIASES.items() for x in pair]), name), name)


def alias(c: Column, words: dict[str, tuple[str, ...]], unknown: str = "keep") -> Column:
    """The word that a value stands for; unknown ones stay in lower case or become null. Only a value that isn't known as it stands is lowered."""
    said = blank_to_null(c)
    low = F.lower(said)
    names = {value: name for name, values in words.items() for value in values}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.coalesce(F.try_element_at(known, said), F.try_element_at(known, low))
    return F.coalesce(found, low) if unknown == "keep" else found


def activity(category: Column) -> Column:
    """Cash-flow class by the first list that has a word within the category."""
    text = match_form(category)
    out = F.lit("unclassified")
    for name, words in reversed(ACTIVITY.items()):
        out = F.when(text.rlike("|".join(words)), name).otherwise(out)
    return out


def mask_iban(c: Column) -> Column:
    bare = F.regexp_replace(blank_to_null(c), r"\s+", "")
    return F.when(F.length(bare) <= 8, bare).otherwise(F.concat(F.left(bare, F.lit(4)), F.lit(" **** **** "), F.right(bare, F.lit(4))))


def mask_id(c: Column) -> Column:
    text = blank_to_null(c)
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2))))


def mask_name(c: Column) -> Column:
    parts = F.split(blank_to_null(c), r"\s+")
    one = lambda p: F.when(F.length(p) == 1, F.lit("*")).otherwise(F.concat(F.left(p, F.lit(1)), F.repeat(F.lit("*"), F.length(p) - 1)))
    return F.array_join(F.transform(parts, one), " ")


def mask_field(name: str, c: Column) -> Column:
    """The mask that a field's name calls for, else the value as it is."""
    low = name.lower()
    if "iban" in low:
        return mask_iban(c)
    if any(x in low for x in ("tax_id", "taxid", "vergi", "vkn", "tckn", "kimlik")):
        return mask_id(c)
    if any(x in low for x in ("employee_name", "personel", "ad soyad", "name")):
        return mask_name(c)
    return c


def tokens(c: Column) -> Column:
    """Words and single marks, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def token_count(c: Column) -> Column:
    return F.coalesce(F.size(tokens(c)), F.lit(0))


def clean_line(c: Column) -> Column:
    plain = F.replace(c, F.lit("﻿"), F.lit(""))
    # searched for as wholes, since most texts hold neither
    plain = F.replace(F.replace(plain, F.lit("\u00a0"), F.lit(" ")), F.lit("\u2010"), F.lit("-"))
    # a single space needs no change, and most are single
    return F.trim(F.regexp_replace(plain, "[ \t]{2,}|\t", " "))


def is_page_number(c: Column) -> Column:
    return F.trim(c).rlike(r"^\s*(-?\s*)?[0-9]{1,4}(\s*-?)?\s*$")


def repeated_form(c: Column) -> Column:
    """The form in which running headers of pages are alike."""
    return F.regexp_replace(F.lower(clean_line(c)), "[0-9]+", "#")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("||", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def strip_bullets(c: Column) -> Column:
    """Lines without leading bullets or numbers."""
    return F.trim(F.regexp_replace(c, r"(?m)^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]+", ""))


def key_points(c: Column, n: int = 5) -> Column:
    """The first n lines or sentences that say something."""
    parts = F.transform(F.split(strip_bullets(c), r"\n+|(?<=[.!?])\s+"), lambda p: F.trim(p))
    return F.slice(F.filter(parts, lambda p: F.length(p) > 0), 1, n)


def citation(name: Column, article: Column, page: Column) -> Column:
    """A source label: law, article and page, as far as they are known."""
    return F.concat_ws(", ", F.coalesce(blank_to_null(name), F.lit("Kaynak")), F.when(blank_to_null(article).isNotNull(), F.concat(F.lit("Madde "), article)), F.when(page.isNotNull(), F.concat(F.lit("s. "), page.cast("string"))))


def looks_like_number(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^[-+(]?[0-9][0-9.,]*\)?-?$"), F.lit(False))
