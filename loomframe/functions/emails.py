"""E-mail functions, column to column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.text import display_name, fold, last_of, let, ordered_distinct, tokens_of

# What an address looks like, plain or obfuscated, and local parts that name no person.
_LOCAL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}"
EMAIL = _LOCAL + r"@(?:[A-Za-z0-9\-]{1,63}\.){1,6}[A-Za-z]{2,24}"
OBFUSCATED = (
    r"(?i)(" + _LOCAL + r")\s{0,3}(?:\[at\]|\(at\)|\{at\}|\bat\b)\s{0,3}"
    r"((?:[A-Za-z0-9\-]{1,63}\s{0,3}(?:\[dot\]|\(dot\)|\.)\s{0,3}){1,6}[A-Za-z]{2,24})"
)
#: Every obfuscated address holds this; it is quick to look for.
_HIDDEN = r"(?i)(?:[\[({]at[\])}]|\bat\b)\s{0,3}[A-Za-z0-9\-]{1,63}\s{0,3}(?:\[dot\]|\(dot\)|\.)"
GENERIC_LOCALS = [
    "info", "contact", "webmaster", "admin", "office", "dept", "department", "help", "support", "web",
    "communications", "news", "events", "advising", "undergrad", "grad", "gradinfo", "chair", "dean",
    "admissions", "hr", "it", "marketing", "ufit", "helpdesk", "feedback", "noreply", "no-reply",
]
GENERIC_LOCAL = (
    r"^(?:.*[-_.])?(webmaster|info|admin|office|contact|noreply|no-reply|helpdesk|support|dept|department|news|events|"
    r"advising|admissions|communications|frontdesk|reception|registrar|feedback|marketing)(?:[-_.0-9].*)?$"
)


def find_emails(text: Column) -> Column:
    """Addresses of a text, lower-cased, the plain ones first, each once."""
    return let(F.coalesce(text, F.lit("")), _found)


def _found(t: Column) -> Column:
    none = F.array().cast("array<string>")
    plain = F.when(F.contains(t, F.lit("@")), F.transform(F.regexp_extract_all(t, F.lit(EMAIL), F.lit(0)), F.lower)).otherwise(none)
    local = F.regexp_extract_all(t, F.lit(OBFUSCATED), F.lit(1))
    domain = F.regexp_extract_all(t, F.lit(OBFUSCATED), F.lit(2))
    dots = lambda d: F.replace(F.regexp_replace(d, r"(?i)\s*(\[dot\]|\(dot\))\s*", "."), F.lit(" "), F.lit(""))
    hidden = F.zip_with(local, domain, lambda a, d: F.lower(F.concat(a, F.lit("@"), dots(d))))
    hidden = F.when(F.regexp_like(t, F.lit(_HIDDEN)), hidden).otherwise(none)
    return let(F.concat(plain, hidden), lambda found: F.when(F.size(found) > 1, ordered_distinct(found)).otherwise(found))


def is_generic(email: Column) -> Column:
    local = F.substring_index(email, "@", 1)
    return F.array_contains(F.lit(GENERIC_LOCALS), local) | F.regexp_like(local, F.lit(GENERIC_LOCAL))


def email_score(email: Column, name: Column, domain: str) -> Column:
    """3 for the surname in the local part, 2 for first initial and start of the surname, 1 for the home domain."""
    return let(_names(name), lambda n: _score(email, n, domain))


def _names(name: Column) -> Column:
    """Surname and first letter; the name is folded once, as a plan holds the tables of each fold."""
    return let(fold(display_name(name)), lambda f: F.struct(last_of(tokens_of(f)).alias("last"), F.substring(f, 1, 1).alias("first")))


def _score(email: Column, n: Column, domain: str) -> Column:
    local = fold(F.substring_index(email, "@", 1))
    last, first = n["last"], n["first"]
    start = F.substring(F.substring_index(last, " ", -1), 1, 4)
    three = (last != "") & F.contains(local, F.replace(last, F.lit(" "), F.lit("")))
    two = (first != "") & (last != "") & F.startswith(local, first) & F.contains(local, start)
    one = F.endswith(F.substring_index(email, "@", -1), F.lit(domain))
    return F.when(three, 3).otherwise(0) + F.when(two, 2).otherwise(0) + F.when(one, 1).otherwise(0)


def pick_email(emails: Column, name: Column, domain: str) -> Column:
    """The best-scoring address that is not generic, the first of equals; '' if there is none."""
    own = F.filter(emails, lambda e: ~is_generic(e))
    scored = let(_names(name), lambda n: F.transform(own, lambda e, i: F.struct(_score(e, n, domain).alias("s"), (-i).alias("o"), e.alias("e"))))
    return F.coalesce(F.array_max(scored)["e"], F.lit(""))


def email_matches(email: Column, name: Column) -> Column:
    """The local part holds the surname or first name, or is the initial and the start of the surname."""
    def letters(c: Column) -> Column:
        return F.regexp_replace(c, "[^a-z]", "")

    def parts(both: Column) -> Column:
        first = let(tokens_of(F.get(both, F.lit(1))), lambda t: F.struct(letters(last_of(t)).alias("last"), letters(F.coalesce(F.get(t, F.lit(0)), F.lit(""))).alias("first")))
        return let(first, lambda n: F.struct(letters(F.get(both, F.lit(0))).alias("local"), n["last"].alias("last"), n["first"].alias("first")))

    folded = F.transform(F.array(F.substring_index(email, "@", 1), display_name(name)), fold)
    def fits(p: Column) -> Column:
        local, last, first = p["local"], p["last"], p["first"]
        by_last = (F.length(last) >= 3) & F.contains(local, last)
        by_first = (F.length(first) >= 3) & F.contains(local, first)
        by_start = (first != "") & (last != "") & F.startswith(local, F.concat(F.left(first, F.lit(1)), F.left(last, F.lit(3))))
        return (local != "") & (by_last | by_first | by_start)

    return let(let(folded, parts), fits)
