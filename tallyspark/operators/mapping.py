"""From an input's columns to a contract: aliases, derived fields and typed records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import money as M
from ..functions import text as X
from ..plans.prompt import plain

# Column names that stand for a field, by field.
FIELD_ALIASES = {
    "date": ("tarih", "islem tarihi", "fatura tarihi", "odeme tarihi", "tarih/date", "date"),
    "description": ("aciklama", "islem aciklamasi", "not", "detay", "notes", "description"),
    "amount": ("tutar", "amount", "toplam", "islem tutari", "hareket tutari"),
    "direction": ("yon", "direction", "islem yonu", "gelir gider", "borc alacak", "hareket tipi"),
    "timezone": ("timezone", "saat dilimi", "time zone", "tz"),
    "category": ("kategori", "category", "grup", "gider kalemi"),
    "counterparty": ("cari/firma", "cari", "firma", "musteri", "tedarikci", "unvan", "counterparty", "cari hesap"),
    "customer": ("musteri", "customer", "cari", "firma"),
    "invoice_no": ("fatura no", "fatura numarasi", "invoice no", "invoice_no", "belge no"),
    "transaction_id": ("transaction id", "islem id", "hareket id", "kayit id"),
    "reference_no": ("reference no", "referans no", "ref no", "belge referansi"),
    "tax_rate": ("kdv orani", "vergi orani", "vat rate", "tax rate", "oran"),
    "tax_amount": ("kdv tutari", "vergi tutari", "vat amount", "tax amount"),
    "quantity": ("miktar", "adet", "quantity", "qty"),
    "unit_price": ("birim fiyat", "unit price", "fiyat", "birim tutar"),
    "product_name": ("urun", "urun adi", "hizmet", "product", "product name", "malzeme"),
    "employee_name": ("personel", "personel adi", "ad soyad", "employee", "employee name", "personel id"),
    "department": ("departman", "department", "birim"),
    "due_date": ("vade", "vade tarihi", "due date", "son odeme tarihi"),
    "payment_status": ("odeme durumu", "payment status", "tahsilat durumu", "durum"),
    "currency": ("para birimi", "currency", "doviz"),
    "debt_amount": ("borc tutari", "borc", "debt amount", "debt", "debit", "gider", "cikis"),
    "receivable_amount": ("alacak tutari", "alacak", "receivable amount", "receivable", "credit", "gelir", "giris"),
    "transaction_type": ("islem tipi", "transaction type", "alis satis", "satis tipi", "tip"),
    "return_status": ("iade durumu", "return status", "refund status", "kismi iade durumu", "return state"),
    "base_amount": ("matrah", "base amount", "kdv haric tutar", "vergi matrahi"),
    "total_amount": ("genel toplam", "toplam tutar", "total amount", "kdv dahil tutar"),
    "gross_salary": ("brut maas", "gross salary", "brut ucret"),
    "net_salary": ("net maas", "net salary", "odeme tutari"),
    "bonus": ("prim", "bonus", "ikramiye"),
    "benefits": ("yan hak", "yan haklar", "benefit", "yemek", "yol"),
    "employer_cost": ("sgk isveren payi", "isveren sgk", "isveren sgk yuku", "isveren yuk", "sgk employer cost", "employer sgk cost", "employer social security"),
    "employer_extra_cost": ("ek isveren maliyeti", "employer extra cost", "ek sgk maliyeti"),
    "total_employer_cost": ("isveren toplam maliyeti", "toplam isveren maliyeti", "total employer cost", "isveren maliyeti", "personel toplam maliyeti"),
    "salesperson": ("satis temsilcisi", "salesperson", "temsilci", "satici"),
    "region": ("bolge", "region", "sehir"),
    "discount": ("indirim", "discount"),
    "total_sales": ("toplam satis", "net satis", "sales total", "total sales"),
    "counterparty_type": ("cari tipi", "counterparty type", "musteri tedarikci"),
    "transaction_direction": ("borc alacak yonu", "transaction direction", "islem yonu", "yon"),
    "product_code": ("stok kodu", "urun kodu", "product code", "stock code"),
    "unit_cost": ("birim maliyet", "unit cost", "alis maliyeti"),
    "warehouse": ("depo", "warehouse"),
    "supplier": ("tedarikci", "supplier", "firma"),
    "sales_price": ("satis fiyati", "sales price"),
    "product_category": ("urun kategorisi", "product category", "stok grubu"),
    "tax_type": ("vergi turu", "tax type", "vergi tipi"),
    "period": ("donem", "period", "beyanname donemi"),
}
# Words that name the two sides of split amount or flag columns.
LEFT_WORDS = ("gider", "expense", "cikti", "cikis", "borc", "debt", "debit")
RIGHT_WORDS = ("gelir", "income", "girdi", "giris", "alacak", "receivable", "credit")
TWO_COLUMN_RULES = ("debit_credit_amount", "debit_credit_direction", "boolean_columns")


def match_field(column: str, fields: list[str]) -> str | None:
    """The field whose alias equals the column's plain name, else one that is within it; the first of the best."""
    name, best, score = plain(column), None, 0
    for f in fields:
        for word in map(plain, FIELD_ALIASES.get(f, (f,))):
            s = 10 if name == word else 5 if word in name else 0
            if s > score:
                best, score = f, s
    return best


@dataclass(frozen=True)
class Rule:
    """Where a field comes from: a column, a constant, or a rule over two columns."""

    kind: str = "missing"
    columns: tuple[str, ...] = ()
    value: str | None = None


def heuristic_mapping(columns: list[str], fields: list[str]) -> dict[str, Rule]:
    """A column for each field by alias; each column serves once."""
    out: dict[str, Rule] = {}
    for c in columns:
        f = match_field(c, [x for x in fields if x not in out])
        if f:
            out[f] = Rule("column", (c,))
    return {f: out.get(f, Rule()) for f in fields}


def direction_pair(columns: list[str]) -> tuple[str | None, str | None]:
    """The columns that name the outgoing and the incoming side best."""

    def best(words: tuple[str, ...]) -> str | None:
        score = {c: sum(10 if plain(c) == w else 5 if w in plain(c) else 0 for w in words) for c in columns}
        top = max(columns, key=lambda c: score[c], default=None)
        return top if top and score[top] else None

    return best(LEFT_WORDS), best(RIGHT_WORDS)


def mapping_problems(mapping: dict[str, Rule], columns: list[str], required: tuple[str, ...]) -> list[str]:
    """What keeps a mapping from being used: unknown columns, a rule's missing second column, required fields without a source."""
    found = [f"{f}: no column {c}" for f, r in mapping.items() for c in r.columns if c not in columns]
    found += [f"{f}: {r.kind} needs two columns" for f, r in mapping.items() if r.kind in TWO_COLUMN_RULES and len(set(r.columns)) < 2]
    return found + [f"{f}: required" for f in required if mapping.get(f, Rule()).kind == "missing"]


def repair_sales_mapping(mapping: dict[str, Rule], columns: list[str]) -> dict[str, Rule]:
    """A return-status column that was taken for the transaction type goes to its own field."""
    rule = mapping.get("transaction_type", Rule())
    if rule.kind == "column" and match_field(rule.columns[0], ["return_status", "transaction_type"]) == "return_status":
        other = next((c for c in columns if c != rule.columns[0] and match_field(c, ["return_status", "transaction_type"]) == "transaction_type"), None)
        return mapping | {"return_status": rule, "transaction_type": Rule("column", (other,)) if other else Rule()}
    return mapping


def both_sides_flagged(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: whether each of two flag columns says yes anywhere."""
    yes = lambda c: F.coalesce(F.bool_or(F.lower(F.trim(F.col(f"`{c}`").cast("string"))).isin(*X.TRUTHY)), F.lit(False))
    return df.agg(yes(left).alias("left_used"), yes(right).alias("right_used"))


def debit_credit_amount(left: Column, right: Column) -> Column:
    return F.when(F.coalesce(right, F.lit(0)) != 0, right).otherwise(left)


def debit_credit_direction(left: Column, right: Column, positive: str = "income", negative: str = "expense") -> Column:
    """The right column wins; without either there is no direction."""
    return F.when(F.coalesce(right, F.lit(0)) != 0, positive).when(F.coalesce(left, F.lit(0)) != 0, negative)


def flag_direction(left: Column, right: Column, positive: str = "income", negative: str = "expense") -> Column:
    yes = lambda c: F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*X.TRUTHY), F.lit(False))
    return F.when(yes(right), positive).when(yes(left), negative)


def signed_direction(amount: Column, positive: str = "income", negative: str = "expense", strict: bool = False) -> Column:
    return F.when(amount.isNull(), None).when((amount > 0) if strict else (amount >= 0), positive).otherwise(negative)


def resolve(rule: Rule) -> Column:
    cols = [F.col(f"`{c}`") for c in rule.columns]
    if rule.kind == "column":
        return cols[0]
    if rule.kind == "constant":
        return F.lit(rule.value)
    if rule.kind == "coalesce":
        return F.coalesce(*[X.blank_to_null(c.cast("string")) for c in cols])
    two = {"debit_credit_amount": debit_credit_amount, "debit_credit_direction": debit_credit_direction, "boolean_columns": flag_direction}
    if rule.kind in two:
        return two[rule.kind](*cols)
    return signed_direction(cols[0]) if rule.kind == "signed_amount_direction" else F.lit(None)


def canonical(df: DataFrame, mapping: dict[str, Rule], numbers: tuple[str, ...] = (), dates: tuple[str, ...] = (), enums: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of a contract: resolved, typed, and without rows where every field is blank."""
    out = []
    for f, rule in mapping.items():
        c = resolve(rule)
        if f in numbers:
            c = M.parse_amount(c.cast("string")).cast(M.WIDE)
        elif f in dates:
            c = D.parse_date(c.cast("string"))
        else:
            c = X.blank_to_null(c.cast("string"))
            c = F.lower(c) if f in enums else c
        out.append(c.alias(f))
    made = df.select(*keep, *out)
    # any field will do; texts first, since a filter below the parsing parses again what it looks at
    plain_first = sorted(mapping, key=lambda f: (f in dates, f in numbers))
    return made.where(reduce(or_, [F.col(f).isNotNull() for f in plain_first]))


def legacy_category(description: Column, direction: Column) -> Column:
    """A category from words in the description, else from the direction."""
    text = X.match_form(description)
    out = F.when(direction == "income", "Gelir").when(direction == "expense", "Gider").when(direction == "debt", "Borc").when(direction == "receivable", "Alacak").otherwise("Diger")
    for name, words in reversed(X.CATEGORY_WORDS.items()):
        out = F.when(text.rlike("|".join(words)), name).otherwise(out)
    return out


def ensure_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def profile(df: DataFrame) -> DataFrame:
    """Each column's rows, blanks, and kind: a date or a number where 7 in 10 filled cells read as such, else text. One pass."""
    aggs = []
    for c in df.columns:
        v = X.blank_to_null(F.col(f"`{c}`").cast("string"))
        dated = v.rlike(r"[-./]")
        aggs += [
            F.count(v).alias(f"{c}|filled"), F.count_if(dated).alias(f"{c}|dated"), F.count_if(dated & D.parse_date(v).isNotNull()).alias(f"{c}|dates"),
            F.count_if(v.rlike(r"^[-+(]?[0-9][0-9.,]*\)?-?$")).alias(f"{c}|numbers"),
        ]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"`{c}|filled`").alias("n_filled"), _kind(c).alias("kind")) for c in df.columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def _kind(c: str) -> Column:
    n = {k: F.col(f"`{c}|{k}`") for k in ("filled", "dated", "dates", "numbers")}
    return F.when((n["dated"] > 0) & (n["dates"] >= 0.7 * n["dated"]) & (n["dated"] >= 0.7 * n["filled"]), "date").when((n["filled"] > 0) & (n["numbers"] >= 0.7 * n["filled"]), "number").otherwise("text")
