"""Address parsing as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ADDR_JUNK, DIRECTIONS, ORDINAL_WORDS, STREET_CANON, STREET_TYPES, UNIT_WORDS
from .text import let, lookup, words


def _digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def unpadded(token: Column) -> Column:
    """Without leading zeros."""
    return F.regexp_replace(token, "^0+", "")


def address_tokens(address: Column) -> Column:
    """Words of a normalised address: split six-digit codes joined, ordinals as numbers, empty words dropped."""
    joined = F.regexp_replace(address, r"\b(\d{3}) (\d{3})\b", "$1$2")
    plain = lambda t: lookup(ORDINAL_WORDS, F.regexp_replace(t, "^([0-9]+)(?:st|nd|rd|th)$", "$1"))
    return F.transform(F.filter(words(joined), lambda t: ~t.isin(ADDR_JUNK)), plain)


def parse_tokens(tokens: Column) -> Column:
    """``(tokens, hnum, postcode)``: the last five- or six-digit word after the first, and the first other number."""
    numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    codes = F.filter(numbered, lambda x: (x["i"] >= 1) & x["t"].rlike("^[0-9]{5,6}$"))

    def with_code(code: Column) -> Column:
        free = lambda x: ~F.coalesce(x["i"] == code["i"], F.lit(False)) & _digits(x["t"]) & F.length(unpadded(x["t"])).between(1, 5)
        first = F.try_element_at(F.filter(numbered, free), F.lit(1))
        return F.struct(tokens.alias("tokens"), unpadded(first["t"]).alias("hnum"), code["t"].alias("postcode"))

    return let(F.try_element_at(codes, F.lit(-1)), with_code)


def street_token(tokens: Column, hnum: Column) -> Column:
    """First street name word after the house number: no number, direction, unit or street type."""
    after = F.coalesce(F.array_position(F.transform(tokens, unpadded), hnum), F.lit(0)).cast("int")
    rest = F.slice(tokens, after + 1, F.greatest(F.size(tokens), F.lit(0)))
    named = F.filter(rest, lambda t: ~_digits(t) & ~t.isin(*DIRECTIONS, *UNIT_WORDS, *STREET_TYPES) & (F.length(t) >= 2))
    return lookup(STREET_CANON, F.try_element_at(named, F.lit(1)))


def address_words(tokens: Column) -> Column:
    """Distinct alphabetic words of three letters or more."""
    return F.array_distinct(F.filter(tokens, lambda t: t.rlike("^[a-z]{3,}$")))


def address_numbers(tokens: Column, postcode: Column) -> Column:
    """The first three different numbers of one to five digits that are not the postcode."""
    held = F.filter(tokens, lambda t: _digits(t) & ~F.coalesce(t == postcode, F.lit(False)) & F.length(unpadded(t)).between(1, 5))
    return F.slice(F.array_distinct(F.transform(held, unpadded)), 1, 3)
