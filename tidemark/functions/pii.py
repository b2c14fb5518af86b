"""Personal data: patterns, predicates, redaction and rules on column names. Every caller uses these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import day

# Patterns of e-mail addresses and phone numbers.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
EMAIL_WHOLE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"(?<!\d)(?:\+?\d[\d\-\s().]{7,}\d)(?!\d)"
PHONE_SHAPE = r"\+?\d[\d\s().-]{7,}\d"

# Words in column names that point to personal data, by category.
NAME_HINTS: dict[str, tuple[str, ...]] = {
    "email": ("email", "e_mail", "mail"),
    "phone": ("phone", "mobile", "telephone", "tel", "cell"),
    "address": ("address", "street", "zipcode", "zip", "postal_code"),
    "government_identifier": ("ssn", "resident", "passport", "driver_license", "national_id"),
}
PERSON_NAMES = (
    "name", "full_name", "first_name", "last_name", "customer_name", "client_name", "employee_name", "staff_name",
    "member_name", "user_name", "username", "person", "contact", "manager", "regional_manager",
)
PERSON_WORDS = ("customer", "client", "employee", "staff", "member", "user", "person", "contact")
# What a release artifact must not hold.
SECRETS: dict[str, str] = {
    "openai_key": r"sk-[A-Za-z0-9]{20,}",
    "aws_access_key_id": r"AKIA[0-9A-Z]{16}",
    "password_in_url": r"(?i)password@",
    "client_secret": r"(?i)client_secret",
    "named_secret_assignment": r"(?i)\b(password|secret|token|api[_-]?key|client_secret|aws_secret_access_key)\b\s*[:=]\s*[^\s,'\"`]+",
    "bearer_token": r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+",
    "postgres_dsn": r"(?i)\bpostgres(?:ql)?://",
    "mysql_dsn": r"(?i)\bmysql://",
    "local_user_path": r"/Users/[^\s\"'`<>]+",
    "worker_id": r"\bworker-\d+\b",
    "leader_id": r"\bleader-fixed\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
#: Keys that carry raw values in nested records.
RAW_KEYS = ("top_values", "sample_rows", "samples", "raw_values", "examples", "values")


def has_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def has_phone(c: Column) -> Column:
    return c.rlike(PHONE)


def has_pii(c: Column) -> Column:
    return has_email(c) | has_phone(c)


def redact(c: Column, email: str = "<redacted_email>", phone: str = "<redacted_phone>") -> Column:
    """E-mail addresses first, then phone-like runs."""
    return F.regexp_replace(F.regexp_replace(c, EMAIL, email), PHONE, phone)


def redact_long_phones(c: Column, email: str = "<redacted_email>", phone: str = "<redacted_phone>") -> Column:
    """As redact(), but only runs of ten digits or more count as phones."""
    ten = r"(?<!\d)\+?(?:\d[\-\s().]*){9,}\d(?!\d)"
    return F.regexp_replace(F.regexp_replace(c, EMAIL, email), ten, phone)


def looks_like_phone(c: Column) -> Column:
    """8 to 15 digits in a phone's shape, without letters, and not a date."""
    digits = F.length(F.regexp_replace(c, r"\D", ""))
    return day(c).isNull() & ~c.rlike("[A-Za-z]") & digits.between(8, 15) & c.rlike(PHONE_SHAPE)


def column_name(c: Column) -> Column:
    """A column's name in lower case with single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def name_categories(c: Column) -> Column:
    """Sorted categories of personal data that a column's name points to."""
    n = column_name(c)
    tokens = F.split(n, "_")
    found = [F.when(n.isin(*hints) | F.arrays_overlap(tokens, F.array(*map(F.lit, hints))), F.lit(kind)) for kind, hints in NAME_HINTS.items()]
    before = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    person = n.isin(*PERSON_NAMES) | ((F.element_at(tokens, -1) == "name") & F.arrays_overlap(before, F.array(*map(F.lit, PERSON_WORDS))))
    return F.array_sort(F.array_compact(F.array(*found, F.when(person, F.lit("person_name")))))
