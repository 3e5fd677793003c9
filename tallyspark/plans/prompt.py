"""Turkish prompts to filter specs: a small grammar, worked on the driver for one prompt at a time."""

from __future__ import annotations

import re
import unicodedata
from calendar import monthrange
from datetime import date, timedelta

from ..functions.text import ASCII, TURKISH
from ..operators.filters import Amount, Category, DateRange, Ranking, Spec

# Month names as prompts write them.
MONTHS = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")
# Which words name a dimension, in the order they are looked for.
DIMENSION_WORDS = {
    "customer": ("musteri",), "counterparty": ("cari", "firma"), "department": ("departman",), "product_name": ("urun",), "salesperson": ("satis temsilcisi", "temsilci", "satici"),
    "region": ("bolge",), "employee_name": ("personel", "calisan"), "tax_type": ("vergi turu",), "period": ("donem",),
}
# The phrases of the grammar, over prompts in plain form but for the day span and categories.
_MONTH = "|".join(MONTHS)
_DAY = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
_AMOUNT = r"\d[\d\s.,]*(?:bin|milyon)?(?:\s*tl)?"
DAY_SPAN = rf"({_DAY})\s*[-–—]\s*({_DAY})"
MONTH_SPAN = rf"(?:(\d{{4}})\s+)?({_MONTH})\s+ayinin\s+basindan(?:\s+itibaren)?\s+(?:(\d{{4}})\s+)?({_MONTH})\s+ayinin\s+sonuna\s+kadar"
LAST_MONTHS = r"son\s+(\d+)\s+ay"
THIS_MONTH, LAST_MONTH = "bu ay", "gecen ay"
MONTHS_OF_YEAR = rf"(?:(\d{{4}})\s+)?({_MONTH})\s+({_MONTH})\s+arasi"
ONE_MONTH = rf"(?:(\d{{4}})\s+)?({_MONTH})\s+ayi"
ONE_YEAR = r"(\d{4})\s+yili"
BETWEEN = rf"({_AMOUNT})\s*(?:ile|ve)\s*({_AMOUNT})\s*arasi"
FROM_UP = rf"({_AMOUNT})\s*(?:uzeri|ustu|ve uzeri|ve ustu)"
UP_TO = rf"({_AMOUNT})\s*alt"
LEAVE_OUT = "dahil etme|gosterme|haric"
TOP = r"en\s+(?:buyuk\s+olan|buyuk|yuksek)\s+(\d+)"
RISKIEST, OVERDUE, VAT_WORD = "en riskli cari", "vadesi gecmis", "kdv"
UNPAID = ("odenmemis", "paid olmayan", "odeme yapilmamis", "acik alacak")
ONLY = {"department": "departmani", "region": r"bolges(?:i|indeki(?:\s+satislari)?)", "counterparty": "carisi", "product_name": "urunu", "customer": "musterisi"}
_FOLD = str.maketrans(TURKISH, ASCII)


def plain(text: str) -> str:
    low = unicodedata.normalize("NFKD", (text or "").strip().translate(_FOLD).lower())
    return re.sub("[^a-z0-9]+", " ", "".join(c for c in low if not unicodedata.combining(c))).strip()


def number(text: str) -> float | None:
    low = text.lower()
    factor = 1e6 if "milyon" in low else 1e3 if "bin" in low else 1.0
    digits = re.sub(r"[^\d,.]", "", low)
    digits = digits.replace(".", "").replace(",", ".") if "," in digits and "." in digits else digits.replace(",", ".")
    try:
        return float(digits) * factor
    except ValueError:
        return None


def _date(text: str) -> date | None:
    parts = [int(x) for x in re.split("[./-]", text)]
    try:
        return date(parts[2] + (2000 if parts[2] < 69 else 1900) if parts[2] < 100 else parts[2], parts[1], parts[0])
    except ValueError:
        return None


def _month_end(year: int, month: int) -> date:
    return date(year, month, monthrange(year, month)[1])


def months_before(day: date, n: int) -> date:
    year, month = divmod(day.year * 12 + day.month - 1 - n, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def _month(name: str) -> int:
    return MONTHS.index(name) + 1


def _day_span(m: re.Match, today: date) -> tuple[date, date] | None:
    ends = [_date(m[1]), _date(m[2])]
    return None if None in ends else (min(ends), max(ends))


def _month_span(m: re.Match, today: date) -> tuple[date, date]:
    years = int(m[1] or m[3] or today.year), int(m[3] or m[1] or today.year)
    first, last = sorted([(years[0], _month(m[2])), (years[1], _month(m[4]))])
    return date(*first, 1), _month_end(*last)


def _previous_month(m: re.Match, today: date) -> tuple[date, date]:
    end = today.replace(day=1) - timedelta(days=1)
    return end.replace(day=1), end


def _months_of_year(m: re.Match, today: date) -> tuple[date, date]:
    year, (a, b) = int(m[1] or today.year), sorted([_month(m[2]), _month(m[3])])
    return date(year, a, 1), _month_end(year, b)


def _one_month(m: re.Match, today: date) -> tuple[date, date]:
    year, k = int(m[1] or today.year), _month(m[2])
    return date(year, k, 1), today if (year, k) == (today.year, today.month) else _month_end(year, k)


#: (phrase, whether it is sought in the plain form, what it means): the first that gives a range holds.
DATE_RULES = (
    (DAY_SPAN, False, _day_span),
    (MONTH_SPAN, True, _month_span),
    (LAST_MONTHS, True, lambda m, today: (months_before(today, int(m[1])), today)),
    (THIS_MONTH, True, lambda m, today: (today.replace(day=1), today)),
    (LAST_MONTH, True, _previous_month),
    (MONTHS_OF_YEAR, True, _months_of_year),
    (ONE_MONTH, True, _one_month),
    (ONE_YEAR, True, lambda m, today: (date(int(m[1]), 1, 1), date(int(m[1]), 12, 31))),
)


def date_range(prompt: str, field: str, today: date) -> DateRange | None:
    """The range that the first fitting phrase means."""
    low = plain(prompt)
    for phrase, in_plain, meaning in DATE_RULES:
        m = re.search(phrase, low if in_plain else prompt)
        ends = meaning(m, today) if m else None
        if ends:
            return DateRange(field, *ends)
    return None


def amount(prompt: str, field: str) -> Amount | None:
    """Between two amounts, from one up, or up to one; to leave out what is below means from it up."""
    if m := re.search(BETWEEN, prompt.lower()):
        ends = sorted(x for x in (number(m[1]), number(m[2])) if x is not None)
        return Amount(field, "between", low=ends[0], high=ends[1]) if len(ends) == 2 else None
    low = plain(prompt)
    for phrase, operator in ((FROM_UP, ">="), (UP_TO, ">=" if re.search(LEAVE_OUT, low) else "<=")):
        m = re.search(phrase, low)
        value = number(m[1]) if m else None
        if value is not None:
            return Amount(field, operator, value)
    return None


def category(prompt: str, columns: list[str]) -> Category | None:
    """What follows "only" before a dimension's word; else a mention of VAT in the first column that may hold it."""
    for field, ending in ONLY.items():
        m = re.search(rf"sadece\s+(.+?)\s+{ending}", prompt, re.I)
        if m and field in columns:
            return Category(field, (m[1].strip(),))
    where = [f for f in ("tax_type", "description", "product_name") if f in columns]
    return Category(where[0], (VAT_WORD.upper(),), contains=True) if VAT_WORD in plain(prompt) and where else None


def ranking(prompt: str, metric: str, columns: list[str]) -> Ranking | None:
    """The riskiest parties, the top of a named dimension, or the top rows."""
    low = plain(prompt)
    m = re.search(TOP, low)
    n = int(m[1]) if m else 10
    if RISKIEST in low:
        return Ranking("risk_score", n, ("counterparty",), "risk_score")
    named = [d for d, words in DIMENSION_WORDS.items() if d in columns and any(w in low for w in words)]
    if named and (m or re.search(r"\ben\b", low)):
        return Ranking(metric, n, (named[0],))
    return Ranking(metric, n) if m else None


def spec(prompt: str, columns: list[str], today: date, date_field: str = "date", amount_field: str = "amount") -> Spec:
    """The filters that a prompt asks for, on columns that there are."""
    low = plain(prompt)
    found, one = amount(prompt, amount_field), category(prompt, columns)
    return Spec(
        dates=date_range(prompt, date_field, today), amounts=(found,) if found else (), categories=(one,) if one else (),
        unpaid=any(x in low for x in UNPAID), overdue=OVERDUE in low, ranking=ranking(prompt, amount_field, columns),
    )
