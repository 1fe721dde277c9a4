"""Cleaning and scalar expressions: every function takes columns and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, texts of true, forms by reporting cycle.
NULL_TOKENS = ("", "nan", "none", "<na>", "nat")
TRUE_TOKENS = ("true", "1", "yes", "y", "t")
FALSE_TOKENS = ("false", "0", "no", "n", "f")
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A")
QUARTERLY_FORMS = ("10-Q", "10-Q/A", "6-K", "6-K/A")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clean_text(x) -> Column:
    """Trimmed text; missing-value tokens and NULL become ''."""
    t = F.trim(_c(x))
    return F.when(F.coalesce(F.lower(t).isin(*NULL_TOKENS), F.lit(True)), "").otherwise(t)


def first_text(x, *order) -> Column:
    """Aggregate: the first text in the rows' order that isn't blank or a missing-value token; '' where there is none."""
    t = clean_text(x)
    return F.coalesce(F.min_by(F.when(t != "", t), F.when(t != "", F.struct(*order))), F.lit(""))


def normalize_cik(x) -> Column:
    """Ten digits: a trailing .0 goes, other characters go, zeros in front; '' without a digit."""
    d = F.regexp_replace(F.regexp_replace(F.trim(_c(x).cast("string")), r"\.0$", ""), r"[^0-9]", "")
    d = F.coalesce(d, F.lit(""))
    return F.when((F.length(d) > 0) & (F.length(d) < 10), F.lpad(d, 10, "0")).otherwise(d)


def normalize_ticker(x) -> Column:
    return F.coalesce(F.regexp_replace(F.upper(F.trim(_c(x))), r"[^A-Z0-9.\-]", ""), F.lit(""))


def parse_bool(x, extra: tuple[str, ...] = (), default: bool = False) -> Column:
    """True for the true tokens and extra ones, false for the false tokens, else default."""
    t = F.lower(F.trim(_c(x).cast("string")))
    return F.when(t.isin(*TRUE_TOKENS, *extra), True).when(t.isin(*FALSE_TOKENS), False).otherwise(default)


def safe_numeric(x) -> Column:
    """Number without thousands commas and percent signs; NULL where there is none or it isn't finite."""
    return finite(F.regexp_replace(F.trim(_c(x).cast("string")), "[,%]", "").try_cast("double"))


def safe_date(x) -> Column:
    return F.try_to_timestamp(_c(x).cast("string")).cast("date")


def safe_divide(a, b) -> Column:
    """NULL where a side is missing or the denominator is 0."""
    return F.try_divide(_c(a), _c(b))


def safe_growth(now, before) -> Column:
    """now / before - 1; a negative base flips the sign."""
    return F.try_divide(_c(now), _c(before)) - 1


def period_type(form) -> Column:
    return F.when(_c(form).isin(*ANNUAL_FORMS), "annual").otherwise("quarterly")


def fiscal_period(fp, form) -> Column:
    """The period named in upper case, else FY or Q by the form's cycle."""
    text = F.upper(F.trim(_c(fp)))
    blank = F.coalesce(text.isin("", "<NA>", "NAN", "NONE"), F.lit(True))
    return F.when(~blank, text).otherwise(F.when(period_type(form) == "annual", "FY").otherwise("Q"))


def accession_key(accn, *parts) -> Column:
    """The accession number, or the parts joined by | where it is missing."""
    text = F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])
    missing = F.coalesce(F.trim(_c(accn)).isin("", "<NA>", "nan", "None"), F.lit(True))
    return F.when(missing, text).otherwise(F.trim(_c(accn)))


def first_of(*columns) -> Column:
    """The first non-missing of several columns in a row."""
    return F.coalesce(*[_c(c) for c in columns])


def first_name_of(*columns: str) -> Column:
    """Which of them it was."""
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])


def available(*columns) -> Column:
    """How many of the columns are not NULL."""
    total = F.lit(0)
    for c in columns:
        total = total + _c(c).isNotNull().cast("int")
    return total


def days_between(start, end) -> Column:
    return F.datediff(_c(end), _c(start))


def is_stale(day, as_of, most: int) -> Column:
    """Older than most days at as_of, or missing."""
    return F.coalesce(F.datediff(_c(as_of), _c(day)) > most, F.lit(True))


def codes(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules]))
