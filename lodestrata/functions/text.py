"""Tokens, identifiers, patterns and text predicates as column expressions (no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-case runs of letters, digits and underscores.
TOKEN = "[a-z0-9_]+"
_SEPARATORS = r"[\s_./\\:-]+"
#: Places between two characters where a word ends.
_WORD_EDGES = (r"(?<=\p{Lower})(?=\p{Upper})", r"(?<=\p{Upper})(?=\p{Upper}\p{Lower})", r"(?<=\p{Alpha})(?=\p{Digit})", r"(?<=\p{Digit})(?=\p{Alpha})")


def tokens(text: Column, least: int = 1) -> Column:
    """All tokens of a text in order; null texts have none.  Only the letters A to Z are folded."""
    found = F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))
    return found if least <= 1 else F.filter(found, lambda t: F.length(t) >= least)


def query_terms(query: str, least: int = 2) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(t for t in re.findall(TOKEN, query.lower()) if len(t) >= least))


def expand_identifier(text: Column) -> Column:
    """The words of an identifier, joined by blanks.

    A word ends at a separator, between letters and digits, before a capital that follows a small letter, and
    before the last of several capitals if a small letter follows it.
    """
    words = F.split(text, _SEPARATORS + "|" + "|".join(_WORD_EDGES))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def has_all_prefixes(found: Column, terms: list[str]) -> Column:
    """Every term is a prefix of some token."""
    return F.forall(F.array(*map(F.lit, terms)), lambda t: F.exists(found, lambda x: x.startswith(t))) if terms else F.lit(False)


def has_any_prefix(found: Column, terms: list[str]) -> Column:
    """Some term is a prefix of some token; no terms match nothing."""
    return F.exists(found, lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: x.startswith(t))) if terms else F.lit(False)


def has_phrase(found: Column, terms: list[str]) -> Column:
    """The terms stand next to each other, in order."""
    if not terms:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" ")).contains(" " + " ".join(terms) + " ")


def folded(text: Column) -> Column:
    """The text in lower case, for tokens; null becomes empty.

    Two letters beyond A to Z (the dotted capital I and the Kelvin sign) would become token letters, and are set aside.
    """
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("\u00df")), F.lit("\u212a"), F.lit("\u00df")))


def token_count(low: Column) -> Column:
    """Number of tokens of a folded text."""
    return F.regexp_count(low, F.lit(TOKEN))


def term_frequency(low: Column, term: str) -> Column:
    """How often a token stands in a folded text; texts without the letters are not searched further."""
    whole = f"(?<![a-z0-9_]){re.escape(term)}(?![a-z0-9_])"
    return F.when(low.contains(term), F.regexp_count(low, F.lit(whole))).otherwise(F.lit(0))


def contains_ci(text: Column, needle: str) -> Column:
    """Literal search without regard to case; nothing in the needle is special."""
    return F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ``*``, ``?`` and classes (``[a-z]``, ``[!x]``) stay within a segment, ``**`` crosses them.

    A bracket that is never closed, or closes at once, means itself.
    """
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0 and "/" not in glob[i:end]:
            inside = glob[i + 1 : end]
            negated = inside[0] in "!^" and len(inside) > 1
            members = re.sub(r"([\\\[\]^&])", r"\\\1", inside[1:] if negated else inside)
            out, i = out + ("(?!/)[^" if negated else "[") + members + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def weighted(*rules: tuple[Column, float]) -> Column:
    """The sum of the weights of the rules that hold; null conditions do not hold."""
    total = F.lit(0.0)
    for condition, weight in rules:
        total = total + F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))
    return total
