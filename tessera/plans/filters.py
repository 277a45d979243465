"""Composable search filters: a request becomes one predicate and a list of semi or anti joins."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_IDS = 10


@dataclass(frozen=True)
class SearchFilter:
    """Structural filters; a field left out does not restrict.

    `ids` and `more_ids` are joined, deduplicated and cut to ten.  With `resolved` (some selector was
    given, say a postcode) an empty list of ids matches nothing rather than everything.
    """

    language: str | None = None
    level: str | None = None
    ids: tuple = ()
    more_ids: tuple = ()
    resolved: bool = False
    party: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    inclusive_end: bool = True
    parliament: int | None = None
    session: int | None = None
    text_like: tuple = ()
    query: str | None = None
    columns: dict = field(default_factory=dict)

    def column(self, name: str) -> str:
        return self.columns.get(name, name)

    def chosen_ids(self) -> list:
        return list(dict.fromkeys([*self.ids, *self.more_ids]))[:MOST_IDS]


def predicate(f: SearchFilter) -> Column:
    parts: list[Column] = []
    for name in ("language", "level", "party"):
        if (v := getattr(f, name)) is not None:
            parts.append(F.col(f.column(name)) == v)
    ids = f.chosen_ids()
    if ids:
        parts.append(F.col(f.column("id")).isin(*ids))
    elif f.resolved:
        parts.append(F.lit(False))
    at = F.col(f.column("at"))
    if f.date_from:
        parts.append(at >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to:
        end = F.lit(f.date_to).cast("date")
        parts.append(at < F.date_add(end, 1).cast("timestamp") if f.inclusive_end else at <= end.cast("timestamp"))
    if f.parliament is not None and f.session is not None:  # a pair: one alone is ignored
        parts += [F.col(f.column("parliament")) == f.parliament, F.col(f.column("session")) == f.session]
    for words in f.text_like:
        parts.append(reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{words}%") for c in f.columns.get("text", ("text",)))))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def require_something(f: SearchFilter) -> None:
    """A search needs a query or at least one filter."""
    if not any((f.query, f.language, f.level, f.chosen_ids(), f.resolved, f.party, f.date_from, f.date_to, f.text_like, f.parliament is not None and f.session is not None)):
        raise ValueError("give a query or at least one filter")


def exclude_presiding(df: DataFrame, role: str) -> DataFrame:
    """Drop rows with a non-empty role."""
    return df.where(F.coalesce(F.col(role), F.lit("")) == "")


def only_active(df: DataFrame, people: DataFrame, key: str, active: bool = True) -> DataFrame:
    """Rows of known people who are active, or are not; unresolved rows leave on either side."""
    return df.join(people.where(F.col("is_active") == active).select(key), key, "left_semi")


def token_search(df: DataFrame, column: Column, words: str, most: int = 6) -> DataFrame:
    """Rows whose folded text holds every one of the first few folded words."""
    from tessera.functions.text import fold

    tokens = [w for w in words.split() if w][:most]
    return df.where(reduce(lambda a, b: a & b, (F.contains(fold(column), fold(F.lit(w))) for w in tokens), F.lit(True)))


def bbox_overlaps(min_x: str, min_y: str, max_x: str, max_y: str, box: tuple[float, float, float, float]) -> Column:
    a, b, c, d = box
    return (F.col(min_x) <= c) & (F.col(max_x) >= a) & (F.col(min_y) <= d) & (F.col(max_y) >= b)
