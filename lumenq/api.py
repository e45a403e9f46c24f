"""A builder for SELECT, for programs that would rather not write whole statements."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from lumenq.session import Session


@dataclass(frozen=True)
class Query:
    session: Session
    table: str
    items: tuple[str, ...] = ("*",)
    conditions: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    first: int | None = None
    skip: int | None = None

    def select(self, *items: str) -> Query:
        return replace(self, items=items)

    def filter(self, condition: str) -> Query:
        return replace(self, conditions=(*self.conditions, condition))

    def order_by(self, *keys: str) -> Query:
        return replace(self, keys=keys)

    def limit(self, n: int, offset: int | None = None) -> Query:
        return replace(self, first=n, skip=offset)

    def nearest(self, column: str, vector: list[float], k: int, metric: str = "l2_distance") -> Query:
        """The ``k`` rows whose vectors are nearest; exact, as a heap per task and one merge."""
        body = ", ".join(f"{'-' if x < 0 else ''}{abs(x):.17f}" for x in vector)
        return self.order_by(f"{metric}({column}, [{body}]){' DESC' if metric == 'inner_product' else ''}").limit(k)

    def sql(self) -> str:
        out = f"SELECT {', '.join(self.items)} FROM {self.table}"
        if self.conditions:
            out += " WHERE " + " AND ".join(f"({c})" for c in self.conditions)
        if self.keys:
            out += " ORDER BY " + ", ".join(self.keys)
        if self.first is not None:
            out += f" LIMIT {self.first}"
        return out + (f" OFFSET {self.skip}" if self.skip is not None else "")

    def df(self) -> DataFrame:
        return self.session.sql(self.sql())


def table(session: Session, name: str) -> Query:
    return Query(session, name)
