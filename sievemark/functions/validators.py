"""Checks of single values, as columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .spans import any_of


#: Decimal digits of all scripts but the usual ones, and the usual ones for them.
_OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd")
_USUAL_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def digits(value: Column) -> Column:
    """Only the digits of a value, those of other scripts as the usual ones."""
    return F.regexp_replace(F.translate(value, _OTHER_DIGITS, _USUAL_DIGITS), r"[^0-9]", "")


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, (_digit(d, i) * w for i, w in enumerate(weights)))


def luhn(value: Column, most: int | None = None) -> Column:
    """Luhn's check of at least 13 digits (at most ``most``, if given)."""
    d = digits(value)
    enough = F.length(d) >= 13 if most is None else F.length(d).between(13, most)
    return F.when(enough, F.call_function("luhn_check", d)).otherwise(False)


def snils_valid(value: Column) -> Column:
    """Control number of a pension insurance number of 11 digits."""
    d = digits(value)
    rest = _weighted(d, tuple(range(9, 0, -1))) % 101
    return F.when(F.length(d) == 11, F.substring(d, 10, 2).cast("int") == rest % 100).otherwise(False)


def inn_valid(value: Column) -> Column:
    """Control digits of a taxpayer number of 10 or 12 digits."""
    d = digits(value)

    def control(weights: tuple[int, ...]) -> Column:
        return _weighted(d, weights) % 11 % 10 == _digit(d, len(weights))

    tail = (2, 4, 10, 3, 5, 9, 4, 6, 8)
    return F.when(F.length(d) == 10, control(tail)).when(F.length(d) == 12, control((7, *tail)) & control((3, 7, *tail))).otherwise(False)


def phone_valid(value: Column) -> Column:
    """Ten digits, with or without a leading 7 or 8, not all the same."""
    d = digits(value)
    own = F.when((F.length(d) == 11) & d.rlike("^[78]"), F.substring(d, 2, 10)).when(F.length(d) == 10, d)
    return F.coalesce(~own.rlike(r"^(\d)\1*$"), F.lit(False))


def email_valid(value: Column) -> Column:
    """A local part, and a domain with a dot that is not at its edge."""
    local, domain = _mail_parts(value)
    return (local != "") & F.contains(domain, F.lit(".")) & ~domain.startswith(".") & ~domain.endswith(".")


def _mail_parts(value: Column) -> tuple[Column, Column]:
    low = F.lower(value)
    at = F.locate("@", low)
    return F.when(at > 0, F.substring(low, F.lit(1), at - 1)).otherwise(low), F.when(at > 0, F.substring(low, at + 1, F.length(low))).otherwise("")


def email_of_role(value: Column) -> Column:
    """A mailbox of a role: every part of its local name is in the list."""
    parts = F.filter(F.split(_mail_parts(value)[0], "[._+-]+"), lambda x: x != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(*vocab.ROLE_LOCAL_PARTS))


def passport_valid(value: Column) -> Column:
    """Ten digits whose first two are not 00."""
    d = digits(value)
    return (F.length(d) == 10) & ~d.startswith("00")


def card_prefix_valid(d: Column) -> Column:
    """Digits that begin as those of a card issuer."""
    four = F.substring(d, 1, 4).cast("int")
    return d.startswith("4") | F.substring(d, 1, 2).cast("int").between(51, 55) | four.between(2221, 2720) | four.between(2200, 2204)


def bik_valid(value: Column) -> Column:
    """Nine digits that begin with 04."""
    return (F.length(value) == 9) & value.startswith("04")


def birth_date_valid(value: Column, this_year: int | None = None) -> Column:
    """A real date of 1900 or later and not after this year (injectable, so that results can be repeated)."""
    day = F.try_to_date(F.regexp_replace(value, "/", "."), "dd.MM.yyyy")
    last = F.lit(this_year) if this_year is not None else F.year(F.current_date())
    return F.coalesce(F.year(day).between(F.lit(1900), last), F.lit(False))


def mrz_valid(value: Column) -> Column:
    """A machine-readable line of a length in use."""
    return F.length(value).isin(30, 36, 44) & value.rlike("^[A-Z0-9<]+$")


def has_person_word(window: Column) -> Column:
    """A word for a person, as a whole word."""
    return window.rlike(rf"(?U)\b(?:{'|'.join(vocab.PERSON_WORDS)})\b")


def person_name(value: Column, near: Column, far: Column) -> Column:
    """Capitalised Cyrillic words that are no section title, with a patronymic or a word for a person near by.

    ``near`` is the window of names of two words, ``far`` that of three.
    """
    words = F.split(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), " ")
    shaped = F.forall(words, lambda w: w.rlike("^[А-ЯЁ][а-яё-]+$") & ~F.lower(w).isin(*vocab.NOT_PERSON))
    patronymic = F.exists(F.slice(words, 2, 2), lambda w: reduce(lambda a, b: a | b, (F.lower(w).endswith(e) for e in vocab.PATRONYMIC_ENDS)))
    return shaped & F.when(F.size(words) == 3, patronymic | has_person_word(far)).otherwise(has_person_word(near))


def address_like(fragment: Column) -> Column:
    """Enough parts of an address in a fragment."""
    street, house, flat = (fragment.rlike(p) for p in (vocab.ADDRESS_STREET, vocab.ADDRESS_HOUSE, vocab.ADDRESS_FLAT))
    postcode = fragment.rlike(vocab.POSTCODE)
    named = fragment.rlike(vocab.ADDRESS_CONTEXT) & ((street & house) | (postcode & street))
    return named | ((F.regexp_count(fragment, F.lit(vocab.ADDRESS_PART)) >= 3) & (house | flat | postcode))


def full_name_like(value: Column) -> Column:
    """Two to five words, each an initial or capitalised, at least one of two letters."""
    v = F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    words = F.split(v, " ")
    return (
        F.length(v).between(3, 120)
        & F.size(words).between(2, 5)
        & F.forall(words, lambda w: w.rlike(vocab.F_NAME_TOKEN))
        & F.exists(words, lambda w: F.length(F.regexp_replace(w, r"\.+$", "")) >= 2)
    )


def field_has(field: Column, words: tuple[str, ...]) -> Column:
    """Does a field's name contain one of the words? Never for a missing name."""
    return F.coalesce(any_of(F.lower(field), words), F.lit(False))


def mentions(text: Column, patterns: tuple[str, ...]) -> Column:
    """Is one of the patterns in the text, whatever its case?"""
    return text.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns))
