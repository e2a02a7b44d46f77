"""Element-wise building blocks: every function maps Columns to a Column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- missing values -------------------------------------------------------

def nan_to_null(c: str | Column) -> Column:
    """One missing-value concept: NaN becomes NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def is_finite(c: str | Column) -> Column:
    """False for NULL, NaN and the infinities."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def fill_label(c: str | Column, label: str = "missing") -> Column:
    return F.coalesce(col(c), F.lit(label))


# ---- text -----------------------------------------------------------------

def is_blank(c: str | Column) -> Column:
    return col(c).isNull() | (F.length(F.trim(col(c))) == 0)


def equals_ci(c: str | Column, text: str) -> Column:
    return F.coalesce(F.lower(col(c)) == text.lower(), F.lit(False))


def matches_ci(c: str | Column, pattern: str) -> Column:
    """Case-insensitive pattern test; a missing text does not match."""
    return F.coalesce(col(c).rlike(f"(?i){pattern}"), F.lit(False))


def capture_ci(c: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col(c), f"(?i){pattern}", group)


def leaf_name(c: str | Column) -> Column:
    """Last part of a path with either kind of separator."""
    return F.regexp_extract(col(c), r"([^/\\]*)$", 1)


def cell_address(row: str | Column, column: str | Column) -> Column:
    """Spreadsheet address (A1, AB7) of a 1-based position, up to column ZZZ."""
    n = col(column).cast("int")
    # bijective base 26: digit k of n, where 26 + 26^2 values come before three letters
    one = F.pmod(n - 1, F.lit(26))
    two = F.floor((n - 1) / 26).cast("int")
    three = F.floor((two - 1) / 26).cast("int")
    letter = lambda d: F.char(F.lit(65) + d)
    return F.concat(
        F.when(n > 702, letter(F.pmod(three - 1, F.lit(26)))).otherwise(""),
        F.when(n > 26, letter(F.pmod(two - 1, F.lit(26)))).otherwise(""),
        letter(one),
        col(row).cast("string"),
    )


def composite_key(cols: Sequence[str], sep: str = "|") -> Column:
    """Text identity of several columns; missing when any part is missing."""
    parts = [F.col(c).cast("string") for c in cols]
    present = parts[0].isNotNull()
    for part in parts[1:]:
        present = present & part.isNotNull()
    return F.when(present, F.concat_ws(sep, *parts))


def url_encode(c: str | Column) -> Column:
    """Percent encoding in which a space is %20 rather than a plus."""
    return F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))


def split_checksum(c: str | Column) -> tuple[Column, Column]:
    """'algo:hex' to its two parts; empty strings when the form is different."""
    pattern = "^([^:]+):(.+)$"
    text = F.coalesce(col(c), F.lit(""))
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def normal_algorithm(c: str | Column) -> Column:
    """Canonical hash name; NULL marks an algorithm that cannot be checked."""
    text = col(c)
    return (
        F.when(text.rlike("(?i)^md5$"), "MD5")
        .when(text.rlike("(?i)^sha-?1$"), "SHA1")
        .when(text.rlike("(?i)^sha-?256$"), "SHA256")
    )


# ---- numbers --------------------------------------------------------------

NUMBER = r"^[+-]?(?:(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|Infinity)$"


def parse_number(c: str | Column) -> Column:
    """Number in invariant notation with optional thousands separators; else NULL.

    Blanks inside, letters other than an exponent, and doubled signs make a text no number.
    """
    text = F.trim(col(c).cast("string"))
    plain = F.regexp_replace(text, r"^\(\s*([^-+\s].*?)\s*\)$", "-$1")
    return nan_to_null(F.when(plain.rlike(NUMBER), F.regexp_replace(plain, ",", "").try_cast("double")))


def to_location(c: str | Column) -> Column:
    """Whole number by truncation of a numeric text; else NULL."""
    return col(c).try_cast("double").try_cast("int")


def clip_lower(c: str | Column, bound: float = 0.0) -> Column:
    """Values below the bound become the bound; missing stays missing."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(bound)))


def row_range(cols: Sequence[str | Column]) -> Column:
    """Largest minus smallest present value of a row."""
    cs = [col(c) for c in cols]
    return F.greatest(*cs) - F.least(*cs)


def percent_change(base: str | Column, value: str | Column, guard: bool = True) -> Column:
    """100 * (value - base) / base. Guarded: a zero base gives NULL. Unguarded: an infinity."""
    a, b = col(base).cast("double"), col(value).cast("double")
    if guard:
        return F.try_divide(100 * (b - a), a)
    limit = F.when(b != a, (b - a) * F.lit(float("inf")))
    return F.when(a == 0, limit).otherwise(100 * F.try_divide(b - a, a))


def ratio(base: str | Column, value: str | Column) -> Column:
    return F.try_divide(col(value).cast("double"), col(base).cast("double"))


def to_percent(c: str | Column) -> Column:
    return 100 * col(c)


def differs(c: str | Column, eps: float = 1e-9) -> Column:
    return F.coalesce(col(c) > eps, F.lit(False))


def same_sign(a: str | Column, b: str | Column) -> Column:
    return F.signum(col(a)) == F.signum(col(b))


def net(inflow: str | Column, outflow: str | Column) -> Column:
    """Difference that exists only when both sides exist."""
    return col(inflow) - col(outflow)


def state_flag(level: str | Column, threshold: float | Column = 0.0) -> Column:
    """1 above the threshold, 0 at or below it, NULL when the level is missing."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (col(level) > limit).cast("int")


# ---- dates ----------------------------------------------------------------

FIRST_SERIAL, LAST_SERIAL = -657434, 2958465  # years 100 to 9999
_NAMED = ("d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
_TIMES = ("", " H:mm:ss", " H:mm")


def date_patterns(day_first: bool = True) -> tuple[str, ...]:
    """Date texts that are read; of two numbers before the year the first is the day, or the month.

    A text that is impossible in that order is read in the other.
    """
    order = ("d/M/yyyy", "M/d/yyyy") if day_first else ("M/d/yyyy", "d/M/yyyy")
    plain = ("yyyy-M-d", *order, *(p.replace("/", "-") for p in order), *(p.replace("/", ".") for p in order))
    return (*(p + t for p in plain for t in _TIMES), *_NAMED, "yyyy-M-d'T'H:mm:ss")


DATE_PATTERNS = date_patterns()


def parse_serial_date(
    c: str | Column,
    expected_year: int | Column | None = None,
    patterns: Sequence[str] = DATE_PATTERNS,
) -> Column:
    """Day serial counted from 1899-12-30, or a date text; else NULL.

    With ``expected_year`` a date outside that year is NULL too.
    """
    text = F.trim(col(c).cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    serial = F.when(number.between(FIRST_SERIAL, LAST_SERIAL), F.floor(number)).cast("int")
    found = [F.date_add(F.lit("1899-12-30").cast("date"), serial)]
    found += [F.to_date(F.try_to_timestamp(text, F.lit(p))) for p in patterns]
    date = F.coalesce(*found)
    if expected_year is None:
        return date
    year = expected_year if isinstance(expected_year, Column) else F.lit(expected_year)
    return F.when(F.year(date) == year, date)


def iso_date(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c).cast("date"), "MM")


def days_inclusive(first: str | Column, last: str | Column) -> Column:
    return F.datediff(col(last), col(first)) + 1


# ---- arrays ---------------------------------------------------------------

def sorted_ci(array: str | Column) -> Column:
    """Ascending order that ignores case: A, all, B."""
    key = F.transform(col(array), lambda s: F.struct(F.lower(s).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(key), lambda p: p["s"])


def joined_set(c: str | Column, sep: str = ",", ignore_case: bool = True) -> Column:
    """Aggregate: distinct values in order, joined. For columns with few distinct values."""
    values = F.collect_set(col(c).cast("string"))
    return F.array_join(sorted_ci(values) if ignore_case else F.array_sort(values), sep)


# ---- rules ----------------------------------------------------------------

def classify(rules: Iterable[tuple[Column, str]], otherwise: str | None) -> Column:
    """First matching rule gives the label; a missing condition does not match."""
    chain = None
    for condition, label in rules:
        hit = F.coalesce(condition, F.lit(False))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(otherwise) if chain is None else chain.otherwise(F.lit(otherwise))


def switch(c: str | Column, cases: dict[str, str], on_default: str = "error") -> Column:
    """Fixed value map; an unknown key aborts the query, or gives NULL."""
    chain = None
    for key, value in cases.items():
        hit = col(c) == key
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    if on_default == "error":
        message = F.concat(F.lit("unexpected key: "), F.coalesce(col(c).cast("string"), F.lit("NULL")))
        return chain.otherwise(F.raise_error(message).cast("string"))
    return chain


# ---- aggregates -----------------------------------------------------------

def plain_sum(c: str | Column) -> Column:
    """Sum in which no value at all gives 0."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def min_count_sum(c: str | Column) -> Column:
    """Sum in which no value at all stays missing."""
    return F.sum(col(c))


def rmse(c: str | Column) -> Column:
    return F.sqrt(F.avg(col(c) * col(c)))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Mean over rows with a finite value and a positive finite weight; NULL if there are none."""
    v, w = col(value), col(weight)
    ok = is_finite(v.cast("double")) & is_finite(w.cast("double")) & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def standard_error(sd: str | Column, n: str | Column) -> Column:
    """Descriptive spatial dispersion over the root of the count."""
    return F.try_divide(col(sd), F.sqrt(col(n).cast("double")))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation over rows that hold both; NULL when either side does not vary."""
    a = F.when(col(y).isNotNull(), col(x).cast("double"))
    b = F.when(col(x).isNotNull(), col(y).cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def share_true(condition: Column) -> Column:
    """Fraction of all rows; a missing comparison counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))
