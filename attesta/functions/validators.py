"""Checks and masks of sensitive values, as column expressions on the matched value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[\s-]", "")


def digit(v: Column, i: int) -> Column:
    return F.substring(v, i + 1, 1).cast("int")


def weighted(v: Column, weights: list[int]) -> Column:
    return sum((digit(v, i) * w for i, w in enumerate(weights)), F.lit(0))


def luhn(v: Column) -> Column:
    return F.call_function("luhn_check", digits(v))


def valid_date(y: Column, m: Column, d: Column) -> Column:
    return (y >= 1900) & F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd").isNotNull()


def resident_status(v: Column) -> Column:
    """valid, form-only (issued without check digit, or it differs) or invalid-date. Twelve weights over twelve digits."""
    d = F.replace(v, F.lit("-"), F.lit(""))
    year = digit(d, 0) * 10 + digit(d, 1)
    full = F.when(year < 50, year + 2000).otherwise(year + 1900)
    month, day = F.substring(d, 3, 2).cast("int"), F.substring(d, 5, 2).cast("int")
    check = F.pmod(11 - F.pmod(weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]), F.lit(11)), F.lit(10))
    late = (full >= 2020) & (month >= 10) & digit(d, 6).isin(0, 9)
    return F.when(~valid_date(full, month, day), "invalid-date").when(~late & (check == digit(d, 12)), "valid").otherwise("form-only")


def business_valid(v: Column) -> Column:
    d = F.replace(v, F.lit("-"), F.lit(""))
    return F.pmod(weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]), F.lit(10)) == F.floor(digit(d, 8) * 5 / 10)


def ip_parts(v: Column) -> Column:
    return F.transform(F.split(v, r"\."), lambda x: x.cast("int"))


def ip_valid(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda x: (x.cast("int") <= 255) & ~x.rlike("^0[0-9]"))


def ip_reserved(v: Column) -> Column:
    p = ip_parts(v)
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))


def mask(kind: Column, v: Column) -> Column:
    """What may be shown of a value of the kind."""
    part = lambda i: F.get(F.split(v, "-"), F.lit(i))
    left, right = (lambda n: F.left(v, F.lit(n))), (lambda n: F.right(v, F.lit(n)))
    address = F.transform(F.split(v, r"\."), lambda x, i: F.when(i < 2, x).otherwise(F.lit("***")))
    jwt = F.split(v, r"\.")
    forms = {
        "resident_number": F.concat(left(6), F.lit("-*******")),
        "mobile_phone": F.concat(part(0), F.lit("-****-****")),
        "landline_phone": F.concat(part(0), F.lit("-****-"), part(2)),
        "toll_free": F.concat(F.lit("15**-"), right(4)),
        "email": F.when(F.locate("@", v) > 3, F.concat(left(2), F.lit("***@"), F.substring_index(v, "@", -1))).otherwise(F.lit("***@***.***")),
        "credit_card": F.concat(F.lit("**** **** **** "), F.right(digits(v), F.lit(4))),
        "business_number": F.concat(left(3), F.lit("-**-"), right(4)),
        "license": F.concat(left(2), F.lit("-**-******-**")),
        "account_number": F.concat(F.lit("***-****"), right(2)),
        "passport_new": F.concat(left(1), F.lit("***"), right(2)),
        "ipv4": F.array_join(address, "."),
        "student_id": F.concat(left(2), F.lit("***"), right(2)),
        "birth_date": F.concat(left(4), F.lit("-**-**")),
        "name": F.concat(left(1), F.lit("*")),
        "address": F.concat(left(2), F.lit("**~")),
        "vehicle_plate": F.concat(left(2), F.lit("가***")),
        "private_key": F.lit("-----BEGIN [PRIVATE KEY REDACTED]-----"),
        "connection_string": F.concat(F.regexp_extract(v, r"^([A-Za-z]+)://", 1), F.lit("://[REDACTED]@"), F.substring_index(v, "@", -1)),
        "bearer_token": F.lit("Bearer …[REDACTED]"),
        "jwt": F.concat(F.left(F.get(jwt, F.lit(0)), F.lit(20)), F.lit("…"), F.left(F.get(jwt, F.lit(2)), F.lit(8))),
    }
    out = F
    for name, form in forms.items():
        out = out.when(kind == name, form)
    return out.otherwise(F.concat(left(4), F.lit("…[REDACTED]")))
