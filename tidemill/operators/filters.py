"""Predicates, as columns: they fold into one filter that reaches the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = "Tümü"


def every(*predicates: Column | None) -> Column:
    """All predicates that are given; true without one."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def any_of(*predicates: Column) -> Column:
    return reduce(or_, predicates, F.lit(False))


def equals_unless_blank(c: str, value: object, sentinel: object = ALL) -> Column | None:
    """Equality, or no predicate for a blank value or the sentinel that means all."""
    return None if value in (None, "", sentinel) else F.col(c) == F.lit(value)


def search(columns: list[str], query: str) -> Column | None:
    """A substring in any of the columns, in lower case; nulls are empty. No predicate for a blank query."""
    q = query.strip().lower()
    return any_of(*(F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q)) for c in columns)) if q else None


def within_dates(c: Column, start: str | None = None, end: str | None = None) -> Column:
    """Between two dates, whole last day included; rows without the date pass."""
    low = c >= F.lit(start).cast("timestamp") if start else F.lit(True)
    high = c < F.lit(end).cast("timestamp") + F.expr("interval 1 day") if end else F.lit(True)
    return c.isNull() | (low & high)


def complete(escalation: Column, missing: Column) -> Column:
    return ~F.coalesce(escalation, F.lit(False)) & (F.coalesce(F.size(missing), F.lit(0)) <= 0)


def registration_queue(file_status: Column, registration: Column) -> Column:
    """In registration or started, and not completed; a missing status is not completed."""
    return (file_status.eqNullSafe("tescil") | registration.eqNullSafe("started")) & ~registration.eqNullSafe("completed")


def closing_queue(file_status: Column, closing: Column) -> Column:
    """Waiting to close, or with a closing status other than closed."""
    return file_status.eqNullSafe("kapanis-bekleyen") | F.coalesce((closing != "") & (closing != "kapandi"), F.lit(False))


def archived(is_archived: Column, operation: Column, wanted: str | None = None) -> Column:
    return every(F.coalesce(is_archived, F.lit(False)), operation == wanted if wanted else None)


def has_all(c: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), c)) == 0


def contains_or_all(c: Column, value: str, universe: list[str]) -> Column:
    """The array holds the value, or the whole universe."""
    return F.array_contains(c, value) | has_all(c, universe)


def status_in(c: Column, wanted: str, sets: dict[str, list[str]]) -> Column:
    """The status is in the set of the wanted filter; a filter without a set takes all."""
    return c.isin(*sets[wanted]) if wanted in sets else F.lit(True)


def active_role(role: Column, status: Column, wanted: str | None = None, active: str = "Aktif") -> Column:
    """Active users, of one role if it is given."""
    return every(status == active, role == wanted if wanted else None)


def on_page(page: Column, wanted: int) -> Column:
    return page == wanted


def has_conflict(mappings: Column, conflict: str = "uyumsuz") -> Column:
    """Whether any mapping (structs with a status) of a declaration conflicts."""
    return F.exists(mappings, lambda m: m["status"] == conflict)


def not_empty(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def allowed(item_capabilities: Column, held: Column) -> Column:
    """An item without capabilities, or with one that is held."""
    return (F.coalesce(F.size(item_capabilities), F.lit(0)) <= 0) | F.arrays_overlap(item_capabilities, held)


def rule_matches(conditions: Column, values: dict[str, Column]) -> Column:
    """Whether all enabled conditions (field, operator, value, enabled) hold: equals or starts_with. An extension: rules are only stored elsewhere."""
    lookup = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))

    def holds(x: Column) -> Column:
        v = F.coalesce(F.element_at(lookup, x["field"]), F.lit(""))
        return ~x["enabled"] | F.when(x["operator"] == "equals", v == x["value"]).otherwise(F.startswith(v, x["value"]))

    return F.forall(conditions, holds)
