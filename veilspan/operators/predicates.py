"""Predicates over values and their context, as columns: true keeps the span."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import around, cut, found, strip


def _compact(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)[\s\-]", "")


def has_digit(text: Column) -> Column:
    return found(text, r"\d")


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\D", ""))


def valid_nric(text: Column) -> Column:
    return found(_compact(text), X.NRIC_FULL)


def nric_like(text: Column) -> Column:
    up = F.upper(_compact(text))
    return valid_nric(text) | found(up, X.NRIC_PREFIX_PIECE, True) | found(up, X.NRIC_TAIL_PIECE, True)


def postal_content(text: Column) -> Column:
    return digit_count(text) >= 4


phone_content = unit_content = has_digit


def content_ok(text: Column, label: Column) -> Column:
    """By filter key: phones, units and blocks need a digit, postal codes four."""
    return (
        F.when(label.isin("SG_PHONE_NUMBER", "SG_CONTACT_NUMBER"), phone_content(text))
        .when(label == "SG_POSTAL_CODE", postal_content(text))
        .when(label.isin("SG_ADDRESS_UNIT_NUMBER", "SG_ADDRESS_BLOCK_NUMBER"), unit_content(text))
        .otherwise(True)
    )


def email_ok(text: Column) -> Column:
    return found(text, X.EMAIL_SHAPE, True) & ~found(text, X.COMPANY_DOMAIN, True)


def phone_ok(text: Column) -> Column:
    return ~found(text, X.MONEY) & ~found(strip(text), X.LETTER_DIGITS)


def valid(text: Column, canon: Column) -> Column:
    """The gate each detection passes on its own text."""
    from .vocab import lookup

    own = F.when(canon == "SG_NRIC_FIN", nric_like(text)).when(canon == "EMAIL_ADDRESS", email_ok(text)).when(canon == "SG_PHONE_NUMBER", phone_ok(text)).otherwise(True)
    return own & content_ok(text, lookup(canon, 1, 2))


def near_address(s: Column, e: Column, addresses: Column, reach: int) -> Column:
    """Whether an address's nearer edge is within reach; inside a long address it may not be."""
    return F.exists(addresses, lambda a: (F.abs(a["s"] - e) <= reach) | (F.abs(s - a["e"]) <= reach))


def address_words(window: Column) -> Column:
    return found(window, X.ADDRESS_CONTEXT, True) | found(window, X.POSTAL_CONTEXT, True)


def postal_context_ok(text: Column, s: Column, e: Column, full: Column, addresses: Column) -> Column:
    return found(_compact(text), r"^\d{6}$") & (address_words(around(full, s, e, 150)) | near_address(s, e, addresses, 150))


def _rejected(s: Column, e: Column, full: Column) -> Column:
    return found(around(full, s, e, 60), X.FLOOR, True) | found(around(full, s, e, 100), X.UNIT_REJECTED, True)


def unit_context_ok(text: Column, s: Column, e: Column, full: Column, addresses: Column) -> Column:
    near = found(around(full, s, e, 60), X.UNIT_CONTEXT, True) | near_address(s, e, addresses, 60)
    return found(strip(text), X.UNIT_CLEAN) | (~_rejected(s, e, full) & near)


def block_context_ok(text: Column, s: Column, e: Column, full: Column, addresses: Column) -> Column:
    near = found(around(full, s, e, 60), X.BLOCK_CONTEXT, True) | near_address(s, e, addresses, 60)
    return ~text.contains("-") & ~found(text, X.UNIT_CONTEXT, True) & ~_rejected(s, e, full) & near


def context_ok(text: Column, label: Column, s: Column, e: Column, full: Column, addresses: Column) -> Column:
    args = (text, s, e, full, addresses)
    return F.when(label == "SG_ADDRESS_BLOCK", block_context_ok(*args)).when(label == "SG_ADDRESS_UNIT", unit_context_ok(*args)).when(label == "SG_POSTAL_CODE", postal_context_ok(*args)).otherwise(True)


def least_confidence(label: Column, threshold: float = X.THRESHOLD) -> Column:
    out = F.lit(threshold)
    for k, v in X.LABEL_THRESHOLDS.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def slice_of_number(full: Column, s: Column, e: Column, reach: int = 3) -> Column:
    """Whether a digit stands within reach on either side."""
    return has_digit(cut(full, F.greatest(F.lit(0), s - reach), s)) | has_digit(cut(full, e, e + reach))


def propagates(value: Column, label: Column) -> Column:
    """Whether another occurrence of the value is surely the same identifier."""
    v = strip(value)
    n_alnum = F.length(F.regexp_replace(v, "[^A-Za-z0-9]", ""))
    n_words = F.size(F.filter(F.split(v, r"(?U)\s+"), lambda w: w != ""))
    return (
        F.when(label.isin("SG_PHONE_NUMBER", "ACCOUNT_NUMBER", "SG_POSTAL_CODE", "SG_NRIC_FIN"), digit_count(v) >= 6)
        .when(label == "EMAIL_ADDRESS", n_alnum >= 6)
        .when(label == "SG_ADDRESS", (n_words >= 2) & (n_alnum >= 6))
        .when(label == "FULL_NAME", n_words >= 2)
        .otherwise(False)
    )


def not_speaker(text: Column, label: Column) -> Column:
    return ~((label == "FULL_NAME") & found(text, X.SPEAKER, True))


def label_literal(text: Column, label: Column) -> Column:
    return strip(F.lower(text)) == strip(F.replace(F.lower(label), F.lit("_"), F.lit(" ")))


def generic_words(text: Column, entity: Column) -> Column:
    out = F.lit(False)
    for k, words in X.GENERIC_WORDS.items():
        out = F.when(entity == k, strip(F.lower(text)).isin(words)).otherwise(out)
    return out


def implausible(text: Column, entity: Column) -> Column:
    no_digit = entity.isin("SG_PHONE_NUMBER", "SG_NRIC_FIN", "SG_POSTAL_CODE") & ~has_digit(text)
    return no_digit | ((entity == "SG_NRIC_FIN") & ~text.rlike("[A-Za-z]"))
