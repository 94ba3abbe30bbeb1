"""Author expressions.

Work records carry ``author`` as an array of structs with ``given``,
``family`` and ``sequence``; rich records carry persons with ``first_name``,
``middle_name``, ``last_name`` and ``initials``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioweave.functions.text import bind, not_blank

# Characters after which a name part starts with a capital.
NAME_DELIMITERS = ".,;:- "


def first_author(authors: Column) -> Column:
    """Family name of the last author marked first, else of the author at position 0."""
    marked = F.filter(
        authors, lambda a: (a["sequence"] == "first") & a["family"].isNotNull()
    )
    return F.coalesce(
        F.get(marked, F.size(marked) - 1)["family"], F.get(authors, F.lit(0))["family"]
    )


def sequence_first_family(authors: Column) -> Column:
    """Family name of the first author marked first, else null."""
    return F.get(F.filter(authors, lambda a: a["sequence"] == "first"), F.lit(0))["family"]


def author_families(authors: Column) -> Column:
    """All family names joined by a space, null when there are none."""
    names = F.filter(F.transform(authors, lambda a: a["family"]), lambda n: n.isNotNull())
    return F.when(F.size(names) > 0, F.array_join(names, " "))


def first_family_name(authors: Column) -> Column:
    """Family name of the first author that has one."""
    return F.get(F.filter(authors, lambda a: a["family"].isNotNull()), F.lit(0))["family"]


def normalise_person_name(c: Column) -> Column:
    """Only the first letter of each name part capitalised."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"[^.,;:\- ]+|[.,;:\- ]+"), F.lit(0))
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))),
        "",
    )


def full_name(person: Column) -> Column:
    """``Last First Middle``."""
    part = lambda name: F.when(not_blank(person[name]), person[name])
    first = F.concat(F.lit(" "), part("first_name"))
    middle = F.concat(F.lit(" "), part("middle_name"))
    return F.concat(
        F.coalesce(part("last_name"), F.lit("")),
        F.coalesce(first, F.lit("")),
        F.coalesce(middle, F.lit("")),
    )


def author_list(persons: Column) -> Column:
    """Full names joined by a comma and a space."""
    return F.array_join(F.transform(persons, full_name), ", ")


def _same_person(known: Column, other: Column) -> Column:
    """Same last name and the same first name, else initials, of ``known``."""
    same_given = (
        F.when(known["first_name"].isNotNull(), known["first_name"].eqNullSafe(other["first_name"]))
        .when(known["initials"].isNotNull(), known["initials"].eqNullSafe(other["initials"]))
        .otherwise(F.lit(True))
    )
    return F.coalesce((known["last_name"] == other["last_name"]) & same_given, F.lit(False))


def _empty_person(person: Column) -> Column:
    return ~(
        not_blank(person["last_name"])
        | not_blank(person["first_name"])
        | not_blank(person["middle_name"])
    )


def dedupe_authors(persons: Column) -> Column:
    """Authors in order without repeats of the first or of an earlier co-author."""

    def dedupe(all_: Column, first: Column) -> Column:
        rest = F.filter(
            F.slice(all_, F.lit(2), F.size(all_)),
            lambda p: ~_empty_person(p) & ~_same_person(p, first),
        )
        kept = F.aggregate(
            rest,
            F.slice(all_, F.lit(1), F.lit(0)),
            lambda acc, p: F.when(F.exists(acc, lambda k: _same_person(k, p)), acc).otherwise(
                F.concat(acc, F.array(p))
            ),
        )
        return F.concat(F.array(first), kept)

    # the list and its first author are made once, not again for every author
    return bind(
        persons,
        lambda all_: F.when(F.size(all_) > 1, bind(F.get(all_, F.lit(0)), lambda first: dedupe(all_, first))).otherwise(all_),
    )
