"""Masks and hashes of found values, as columns; a raw value never leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import trim
from .validators import digits


def value_hash(value: Column) -> Column:
    """The first 16 hexadecimal digits of the value's SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 16)


def mask_tail(value: Column, visible: int = 4) -> Column:
    """All but the last characters masked; all of them in a value no longer than ``visible``."""
    n = F.length(value)
    return F.when(n <= visible, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - visible), F.right(value, F.lit(visible)) if visible else F.lit("")))


def mask(category: Column, value: Column) -> Column:
    """The mask of a value, by its category."""
    v = trim(value)
    d = digits(v)
    at = F.locate("@", v)
    mail = F.when(at > 1, F.concat(F.substring(v, 1, 1), F.lit("***@"), F.substring(v, at + 1, F.length(v)))).when(at == 1, F.concat(F.lit("***@"), F.substring(v, at + 1, F.length(v)))).otherwise("***")
    cores = F.filter(F.transform(F.split(v, r"(?U)\s+"), lambda p: F.regexp_replace(p, r"\.+$", "")), lambda p: p != "")
    name = F.array_join(F.transform(cores, lambda p: F.concat(F.substring(p, 1, 1), F.lit(".("), F.length(p).cast("string"), F.lit(")"))), " ")
    head = F.when(F.length(v) > 6, F.concat(F.substring(v, 1, 6), F.lit("..."))).otherwise("***")
    year = F.regexp_extract(v, r"^\d{1,2}[./]\d{1,2}[./]((?:19|20)\d{2})", 1)
    return (
        F.when(category == "EMAIL", mail)
        .when(category == "PHONE", mask_tail(d, 2))
        .when(category == "CVV", mask_tail(d, 0))
        .when(category.isin("PASSPORT_RF", "SNILS", "INN_PERSONAL", "INN_LEGAL", "BANK_CARD", "BANK_ACCOUNT", "BIC", "DRIVER_LICENSE"), mask_tail(d, 4))
        .when(category == "MRZ", F.when(F.length(v) > 10, F.concat(F.substring(v, 1, 5), F.lit("..."), F.right(v, F.lit(2)))).otherwise("***"))
        .when(category == "FIO", F.when(name == "", "***").otherwise(name))
        .when(category.isin("ADDRESS", "BIRTH_PLACE"), head)
        .when(category == "BIRTH_DATE", F.when(year == "", "**.**.****").otherwise(F.concat(F.lit("**.**."), year)))
        .otherwise(F.concat(F.lit("["), category, F.lit("]")))
    )
