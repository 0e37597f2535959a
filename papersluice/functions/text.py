"""Text and date expressions: normalising, validating, measuring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papersluice.sources import rules

EDGE = r"(?:^|(?<=[^A-Za-z0-9_]))"
END = r"(?![A-Za-z0-9_])"
MAX_YEAR = 2024


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found(x: Column) -> Column:
    """A match, or null where there is none."""
    return F.when(x != "", x)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def collapse_ws(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))


def clean_ocr_noise(t: Column) -> Column:
    bare = F.regexp_replace(t, "[।॥|]+", "")
    dashes = F.regexp_replace(bare, r"\s+[-–—]\s+", " ")
    return collapse_ws(F.regexp_replace(dashes, r"[^\p{L}\p{N}_\s\x{0900}-\x{097F}.,/:()\-]", ""))


def numeric_confusions(t: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(t, F.lit("")), "OoIliSsBGZz", "00111558622"), r"[^0-9.,-]", "")


def devanagari_digits(t: Column) -> Column:
    return F.translate(F.coalesce(t, F.lit("")), "०१२३४५६७८९", "0123456789")


def squeeze_layout(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), " {2,}", " "), r"\n+", "\n"), r"^\s+|\s+\z", "")


def split_camel(t: Column) -> Column:
    return collapse_ws(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"))


def bare_upper(t: Column) -> Column:
    return F.regexp_replace(F.upper(t), r"[\s-]+", "")


def format_registration(t: Column) -> Column:
    return F.regexp_replace(bare_upper(t), r"^(.{2})(.{2})([A-Z]*)(.*)$", "$1-$2-$3-$4")


def fix_pan(t: Column) -> Column:
    """Repair of ten characters by place; null if one of the first nine can't be."""
    letters, digits = ("015826", "OISBZG"), ("OQDILSBZA", "000115824")
    head, middle, last = (F.translate(F.substring(t, *at), *kind) for at, kind in (((1, 5), letters), ((6, 4), digits), ((10, 1), letters)))
    return F.when((F.length(t) == 10) & head.rlike(r"^\p{L}{5}\z") & middle.rlike(r"^[0-9]{4}\z"), F.concat(head, middle, last))


def is_numeric(token: Column) -> Column:
    bare = F.regexp_replace(token, r"[,.\s$€£¥]", "")
    return F.when(F.length(bare) == 0, F.lit(False)).otherwise(F.regexp_count(bare, F.lit("[0-9]")) / F.length(bare) > 0.5)


def is_stopword(token: Column) -> Column:
    return F.lower(token).isin(rules.STOPWORDS)


def normalize_date(t: Column) -> Column:
    clean = F.regexp_replace(t, r"[^0-9/\-.]", "")
    dmy, ymd = r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{4})\z", r"^([0-9]{4})[/\-.]([0-9]{1,2})[/\-.]([0-9]{1,2})\z"
    joined = lambda p, d, m, y: F.when(clean.rlike(p), F.concat_ws("/", F.lpad(F.regexp_extract(clean, p, d), 2, "0"), F.lpad(F.regexp_extract(clean, p, m), 2, "0"), F.regexp_extract(clean, p, y)))
    return F.coalesce(joined(dmy, 1, 2, 3), joined(ymd, 3, 2, 1))


#: Formats tried in order, month first; narrower than a lenient parser, which also reads names of months and partial dates.
DATE_FORMATS = ("M-d-yyyy", "d-M-yyyy", "yyyy-M-d")


def standardize_date(t: Column) -> Column:
    dashed = F.regexp_replace(t, "[./]", "-")
    return F.date_format(F.coalesce(*[F.try_to_timestamp(dashed, F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd")


def plausible_date(t: Column, min_year: int = 1900, max_year: int = MAX_YEAR) -> Column:
    """Three parts with / or -; day to 31, month to 12, year in range; two-digit years above 50 are 19xx. No calendar check."""
    p = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{1,4})\z"
    part = lambda i: F.regexp_extract(t, p, i).try_cast("int")
    y = part(3)
    year = F.when(F.length(F.regexp_extract(t, p, 3)) == 2, F.when(y > 50, 1900 + y).otherwise(2000 + y)).otherwise(y)
    return F.coalesce(t.rlike(p) & part(1).between(1, 31) & part(2).between(1, 12) & year.between(min_year, max_year), F.lit(False))


def valid_aadhaar(t: Column) -> Column:
    return devanagari_digits(t).rlike(r"^[2-9][0-9]{11}\z")


def valid_pan(t: Column) -> Column:
    return t.rlike(r"^[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]\z")


def valid_registration(t: Column) -> Column:
    return t.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}\z") & F.substring(t, 1, 2).isin(rules.STATE_CODES) & (F.substring(t, 3, 2) != "00")


def _holds(t: Column, parts: list[str]) -> Column:
    return any_of([F.contains(F.lower(t), F.lit(p)) for p in parts])


def valid_name_aadhaar(t: Column) -> Column:
    dotless = F.replace(t, F.lit("."), F.lit(""))
    alphabetic = dotless.rlike(r"^[\p{L}\s]*\z") & F.trim(t).rlike(r"\S")
    single = ~F.trim(t).rlike(r"\s") & (F.length(F.trim(dotless)) < 2)
    return ~_holds(t, rules.NOT_NAMES["aadhaar"]) & (F.length(t) >= 3) & alphabetic & ~single


def _two_words(t: Column) -> Column:
    return F.trim(t).rlike(r"^\p{L}{2,}(\s+\p{L}{2,})+\z")


def valid_name_pan(t: Column) -> Column:
    return ~_holds(t, rules.NOT_NAMES["pan"]) & _two_words(t) & (F.length(t) <= 50)


def valid_name_rc(t: Column) -> Column:
    return ~_holds(t, rules.NOT_NAMES["vehicle_rc"]) & _two_words(t)


def special_ratio(t: Column) -> Column:
    """Share of characters that are no letter, number or white space; 0 for an empty text."""
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")) / F.length(t)).otherwise(F.lit(0.0))


def digit_ratio(t: Column) -> Column:
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit("[0-9]")) / F.length(t)).otherwise(F.lit(0.0))


def distribution_score(t: Column, kind: Column) -> Column:
    """How well shares of digits and special characters fit the type's profile."""
    score = F.lit(1.0)
    for name, (least, most, _, _) in rules.PROFILES.items():
        low = F.when(digit_ratio(t) < least, (least - digit_ratio(t)) / least * 0.5).otherwise(0.0)
        high = F.when(special_ratio(t) > most, (special_ratio(t) - most) / (1.0 - most) * 0.8).otherwise(0.0)
        score = F.when(kind == name, F.greatest(F.lit(0.0), F.lit(1.0) - low - high)).otherwise(score)
    return F.when(F.length(t) > 0, score).otherwise(0.0)


def kv_score(t: Column, kind: str) -> Column:
    low = F.lower(t)
    has = lambda *ks: any_of([F.contains(low, F.lit(k)) for k in ks])
    score = F.lit(0.5)
    if kind == "invoice":
        score = score + F.when(has("total") & low.rlike("[0-9]"), 0.3).otherwise(0.0) + F.when(has("invoice"), 0.2).otherwise(0.0)
    elif kind == "id_document":
        score = score + F.when(has("dob", "birth"), 0.25).otherwise(0.0) + F.when(has("id", "no.", "number"), 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def date_reason(day: Column, shown: Column, name: str, as_of: Column, max_age: int = 365) -> Column:
    """Why a date fails, or null. Dates that can't be read (null) pass."""
    said = lambda a, b="": F.concat(F.lit(a), shown, F.lit(b))
    if name in ("date_of_birth", "dob"):
        return F.when(day > as_of, said("Future DOB detected: ")).when(F.datediff(as_of, day) > 365 * 120, said("DOB unreasonably old: "))
    if "expiry" in name or "valid_until" in name:
        return F.lit(None).cast("string")
    return F.when(F.datediff(day, as_of) > 1, said(f"Future date detected in {name}: ")).when(F.datediff(as_of, day) > max_age, said(f"Date too old in {name}: ", f" (> {max_age} days)"))


def amount_reason(amount: Column, name: str, least: float = 0.0, most: float = 1_000_000.0) -> Column:
    """Why an amount fails, or null. Text keeps its digits and dots; what is no number passes."""
    v = F.regexp_replace(amount.cast("string"), "[^0-9.]", "").try_cast("double")
    return F.when(v <= least, F.lit(f"Amount too small in {name}")).when(v > most, F.lit(f"Amount too large in {name}"))
