"""Scalar functions: overloads by parameter types, chosen by the cost of implicit casts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenq.errors import BinderError
from lumenq.types import DOUBLE, Type, cast_cost

VECTOR = Type("VECTOR")


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple[Type, ...]
    result: Type
    build: Callable[..., Column]
    variadic: bool = False  # the last parameter may be repeated
    null_in_null_out: bool = True
    check: Callable[[list[Type]], None] | None = None

    def expected(self, n: int) -> tuple[Type, ...] | None:
        if len(self.params) == n:
            return self.params
        if self.variadic and n > len(self.params):
            return self.params + self.params[-1:] * (n - len(self.params))
        return None

    def column(self, args: list[Column]) -> Column:
        out = self.build(*args)
        if not self.null_in_null_out:
            return out
        missing = F.lit(False)
        for a in args:
            missing = missing | a.isNull()
        return F.when(~missing, out)


class Registry:
    def __init__(self, functions: list[Function] = ()):
        self._by_name: dict[str, list[Function]] = {}
        for f in functions:
            self.register(f)

    def register(self, f: Function) -> None:
        same = self._by_name.setdefault(f.name.lower(), [])
        if any(g.params == f.params and g.variadic == f.variadic for g in same):
            raise BinderError("DuplicateFunction", f.name)
        same.append(f)

    def resolve(self, name: str, args: list[Type]) -> Function:
        """The overload with the least summed cast cost; equal costs are ambiguous."""
        found = self._by_name.get(name.lower())
        if not found:
            raise BinderError("FunctionNotFound", name)
        costs = []
        for f in found:
            want = f.expected(len(args))
            each = [cast_cost(a, b) for a, b in zip(args, want, strict=True)] if want else [None]
            if None not in each:
                costs.append((sum(each), f))
        if not costs:
            raise BinderError("InvalidArguments", f"{name}({', '.join(map(str, args))})")
        least = min(c for c, _ in costs)
        best = [f for c, f in costs if c == least]
        if len(best) > 1:
            raise BinderError("AmbiguousFunction", name)
        if best[0].check:
            best[0].check(args)
        return best[0]


def _sum(a: Column, b: Column, term) -> Column:
    """A sequential sum over two vectors of one length; other lengths are an error at run time."""
    total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def cosine_distance(a: Column, b: Column) -> Column:
    norms = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - inner_product(a, b) / F.when(norms == 0, F.lit(1.0)).otherwise(norms))


def _same_dimension(args: list[Type]) -> None:
    if any(a.name == "NULL" for a in args):
        raise BinderError("InvalidType", "a vector distance takes no NULL literal")
    if args[0].size is not None and args[1].size is not None and args[0].size != args[1].size:
        raise BinderError("InvalidType", f"vectors of {args[0].size} and {args[1].size} dimensions")


def builtin() -> Registry:
    return Registry([Function(f.__name__, (VECTOR, VECTOR), DOUBLE, f, check=_same_dimension) for f in (l2_distance, inner_product, cosine_distance)])
