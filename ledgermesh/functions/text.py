"""Name normalisation and tokens as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import HONORIFIC, LEET_FROM, LEET_TO, LEGAL, LEGAL_GLUED, NAME_CANON, STOP



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """The word that ``key`` stands for, or itself."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), key)


def fold(text: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII text is returned as it is."""
    split = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(split, r"\p{Mn}+", "")).otherwise(text)


def norm_text(text: Column) -> Column:
    """Lower case, folded, & as a word, apostrophes dropped, other characters as single spaces; null is empty."""
    t = fold(F.lower(F.coalesce(text, F.lit(""))))
    t = F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]+", " "), " +", " "))


def profile_norm(text: Column) -> Column:
    """The plainer form that profiles compare: lower case, no accents, other characters as spaces, collapsed."""
    t = fold(F.lower(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]", " "), " +", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " +"), lambda t: t != "")


def canon_token(token: Column) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[a-z]")
    return lookup(NAME_CANON, F.when(mixed, F.translate(token, LEET_FROM, LEET_TO)).otherwise(token))


def singular(token: Column) -> Column:
    return F.when((F.length(token) > 4) & token.endswith("s") & ~token.endswith("ss"), F.regexp_replace(token, "s$", "")).otherwise(token)


def strip_glued(text: Column, least: int) -> Column:
    """Without the legal forms glued to its end, the longest first, as long as ``least`` characters are left before each.

    A form has three letters or more, so a word is stripped no more often than its length allows.
    """
    pattern = rf"^(.{{{least},}}?)(?:{'|'.join(LEGAL_GLUED)})$"
    rounds = F.sequence(F.lit(0), F.floor(F.length(text) / min(map(len, LEGAL_GLUED))).cast("int"))
    stripped = F.aggregate(rounds, text, lambda t, _: F.regexp_replace(t, pattern, "$1"))
    return F.when(text.rlike(pattern), stripped).otherwise(text)


def unglue_legal(token: Column) -> Column:
    """The token without glued legal forms; null if nothing but legal forms is left."""
    return F.when(token.isin(LEGAL), None).otherwise(let(strip_glued(token, 3), lambda t: F.when(t.isin(LEGAL), None).otherwise(t)))


def name_tokens(name: Column) -> Column:
    """Core words of a normalised name in order, each once; all its words if none is core."""
    kept = lambda t: ~t.isin(*STOP, *HONORIFIC, "dba") & (F.length(t) > 1) & ~t.rlike("^[0-9]{4,}$")
    raw = F.filter(F.transform(words(name), canon_token), kept)

    def pick(r: Column) -> Column:
        core = F.array_distinct(F.filter(F.transform(r, unglue_legal), lambda t: t.isNotNull()))
        return let(core, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array_distinct(r)))

    return let(raw, pick)


def dba_parts(name: Column) -> Column:
    """The sides of 'x dba y'; empty where there is no such word."""
    framed = F.concat(F.lit(" "), name, F.lit(" "))
    parts = F.filter(F.transform(F.split(framed, " dba "), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(framed.contains(" dba "), parts).otherwise(F.array().cast("array<string>"))


def compact(tokens: Column) -> Column:
    return strip_glued(F.array_join(tokens, ""), 4)
