"""Column functions over contact data: e-mail addresses and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions.text import or_empty

# Fixed value: an address stands at the start or after white space.
EMAIL = r"(?:^|(?<=\s))([a-zA-Z0-9](?:[a-zA-Z0-9._%+-]*[a-zA-Z0-9])?@[a-zA-Z0-9](?:[a-zA-Z0-9.-]*[a-zA-Z0-9])?\.[a-zA-Z]{2,})"
# Domains of made-up or unusable addresses.
BLOCKED_DOMAINS = ("example.com", "example.org", "example.net", "test.com", "test.org", "fake.com", "fake.org", "domain.com", "domain.tld", "yourdomain.com", "sentry.io", "wixpress.com", "email.com", "mail.com")

# The national plan. Country code; mobile numbers are 5, 6 or 7 and eight digits; landlines have eight digits.
COUNTRY = "213"
MOBILE, LANDLINE, VOIP, TOLL_FREE, PREMIUM = r"^[567]\d{8}$", r"^[1-4]\d{7}$", r"^98[23]\d{6}$", r"^800\d{6}$", r"^80[3-689]\d{6}$"
#: Digits with single separators between them, as they stand in text.
CANDIDATE = r"(?<![\d+])(?:\+|00)?\d(?:[ .\-/()]{0,2}\d){7,14}(?!\d)"

PHONE_TYPE = "struct<original_string:string,e164:string,international:string,national:string,phone_type:string,region:string,carrier:string,is_valid:boolean>"
# Operators by the first digit of a mobile number.
CARRIERS = {"5": "Ooredoo", "6": "Mobilis", "7": "Djezzy"}


def emails(text: Column) -> Column:
    """Addresses in order of their first occurrence, lower case, each once, none of a blocked domain."""
    found = F.transform(F.regexp_extract_all(or_empty(text), F.lit(EMAIL), F.lit(1)), lambda e: F.btrim(F.lower(e), F.lit(".")))
    return F.array_distinct(F.filter(found, lambda e: ~F.substring_index(e, "@", -1).isin(*BLOCKED_DOMAINS)))


def first_email(text: Column) -> Column:
    return F.get(emails(text), F.lit(0))


def national_digits(raw: Column) -> Column:
    """Digits of the national plan without the trunk zero; a foreign country code gives null."""
    d = F.regexp_replace(or_empty(raw), r"[^\d+]", "")
    d = F.regexp_replace(d, r"^00", "+")
    bare = F.when(d.startswith("+" + COUNTRY), F.substring(d, 5, 32)).when(d.startswith("+"), None).when(d.rlike(rf"^{COUNTRY}\d{{8,9}}$"), F.substring(d, 4, 32)).otherwise(d)
    return F.regexp_replace(bare, "^0", "")


def phone(raw: Column) -> Column:
    """PHONE_TYPE of one number of the national plan, null if it is none."""
    n = national_digits(raw)
    kind = F.when(n.rlike(MOBILE), "MOBILE").when(n.rlike(TOLL_FREE), "TOLL_FREE").when(n.rlike(PREMIUM), "PREMIUM_RATE").when(n.rlike(VOIP), "VOIP").when(n.rlike(LANDLINE), "LANDLINE")
    nine = F.length(n) == 9
    spaced = F.when(nine, F.regexp_replace(n, r"^(\d{3})(\d{2})(\d{2})(\d{2})$", "$1 $2 $3 $4")).otherwise(F.regexp_replace(n, r"^(\d{2})(\d{2})(\d{2})(\d{2})$", "$1 $2 $3 $4"))
    national = F.when(nine, F.regexp_replace(n, r"^(\d{3})(\d{2})(\d{2})(\d{2})$", "0$1 $2 $3 $4")).otherwise(F.regexp_replace(n, r"^(\d{2})(\d{2})(\d{2})(\d{2})$", "0$1 $2 $3 $4"))
    carrier = F.when(kind == "MOBILE", F.when(n.startswith("5"), CARRIERS["5"]).when(n.startswith("6"), CARRIERS["6"]).otherwise(CARRIERS["7"]))
    made = F.struct(
        F.trim(raw).alias("original_string"), F.concat(F.lit("+" + COUNTRY), n).alias("e164"), F.concat(F.lit(f"+{COUNTRY} "), spaced).alias("international"), national.alias("national"),
        kind.alias("phone_type"), F.lit("Algeria").alias("region"), carrier.alias("carrier"), F.lit(True).alias("is_valid"),
    )
    return F.when(kind.isNotNull(), made).cast(PHONE_TYPE)


def distinct_phones(numbers: Column) -> Column:
    """The first of each E.164 number, in order."""
    keys = F.transform(numbers, lambda p: p["e164"])
    return F.filter(numbers, lambda p, i: F.array_position(keys, p["e164"]) == i + 1)


def phones(text: Column) -> Column:
    """All valid numbers in a text, each once, in order."""
    found = F.transform(F.regexp_extract_all(or_empty(text), F.lit(CANDIDATE), F.lit(0)), phone)
    return distinct_phones(F.filter(found, lambda p: p.isNotNull()))
