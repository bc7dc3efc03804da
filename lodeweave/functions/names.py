"""Scalar string rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVERSE = "_(inv)"
#: Attribute names whose values are names of the entity (fixed values).
NAME_ATTRIBUTES = (
    "name", "label", "title", "nick", "nickname", "alias", "aka", "also known as", "alternative name", "alternative names", "other name", "other names",
    "othername", "othernames", "other", "others", "altname", "altnames", "alt", "alsoknownas", "alsoknown", "alsoknowns", "alsoknownsa",
    "givenname", "givennames", "given", "firstname", "firstnames", "first", "forename", "forenames", "fore", "surname", "surnames", "sur",
    "lastname", "lastnames", "last", "familyname", "familynames", "family", "maidenname", "maidennames", "maiden", "birthname", "birthnames", "birth",
    "originalname", "originalnames", "original", "realname", "realnames", "real", "truenames", "truename", "true", "legalname", "legalnames", "legal",
    "officialname", "officialnames", "official", "formalname", "formalnames", "formal", "commonname", "commonnames", "common", "nicknames",
    "pseudonym", "pseudonyms", "pseudo", "penname", "pennames", "pen", "st",
)
#: "answer", perhaps "should be" or "is" and a sign, then one letter in brackets, with any white space between.
#: Every run is possessive, so long white space is read once.
ANSWER = r"(?iU)answer\s*+(?:should\s++be\s*+)?(?:is\s*+)?[:=]?\s*+\(([a-zA-Z])\)"


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def predicate_name(url: Column) -> Column:
    """Last path segment, without the inverse suffix, camel case split, lower case."""
    name = F.regexp_replace(last_segment(url), r"_\(inv\)$", "")
    return F.lower(F.replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2"), F.lit("_"), F.lit(" ")))


def entity_name(url: Column) -> Column:
    return F.replace(last_segment(url), F.lit("_"), F.lit(" "))


def clean_literal(text: Column) -> Column:
    """A quoted RDF literal without escapes, type and language; anything else as it is."""
    t = F.replace(F.replace(text, F.lit('\\"'), F.lit("")), F.lit("\\"), F.lit(""))
    t = F.when(F.contains(t, F.lit("^^")), F.regexp_replace(F.split_part(t, F.lit("^^"), F.lit(1)), '^"|"$', "")).otherwise(t)
    return F.when(F.contains(t, F.lit('"@')), F.regexp_replace(F.split_part(t, F.lit('"@'), F.lit(1)), '^"', "")).otherwise(F.regexp_replace(t, '^"(.*)"$', "$1"))


def parse_answer(text: Column) -> Column:
    """The letter of a multiple-choice answer in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(text, ANSWER, 1)), F.lit(""))


def hash_order(seed: str, key: Column) -> Column:
    """A reproducible pseudo-random number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
