"""SELECT as a DataFrame: filter, sort keys, sort, offset and limit, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenq.operators.expressions import column, compile_
from lumenq.plans.binder import BoundSelect

RID = "_rid"


def select(df: DataFrame, q: BoundSelect, tiebreak: list[str] = ()) -> DataFrame:
    """``tiebreak``: columns that give the input order, by which ties and unsorted limits go.

    Sort keys are computed over the source columns before the projection, so a key may be
    any expression.  With a limit the plan is one TakeOrderedAndProject: a heap in every
    task and one merge.  Constant keys sort nothing and are left out.
    """
    if q.where is not None:
        df = df.filter(compile_(q.where))
    keys = [compile_(e).desc_nulls_last() if descending else compile_(e).asc_nulls_last() for e, descending in q.order if not e.constant]
    if keys or q.limit is not None or q.offset is not None:
        keys += [column(c).asc() for c in tiebreak]
    if keys:
        df = df.orderBy(*keys)
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.select(*[compile_(e).alias(name) for name, e in q.items])


_METRICS = {"l2_distance": ("L2", False), "cosine_distance": ("COSINE", False), "inner_product": ("INNER_PRODUCT", True)}


def access_path(q: BoundSelect, indexes: list[dict], vindexes: list[dict]) -> str:
    """Which access path the declared indexes allow; Spark's own plan doesn't depend on it."""
    if q.limit and len(q.order) == 1:
        e, descending = q.order[0]
        metric = _METRICS.get(e.value.name.lower()) if e.op == "call" else None
        if metric and metric[1] == descending and sum(a.constant for a in e.args) == 1:
            col = next((a.value for a in e.args if a.op == "column"), None)
            found = [v for v in vindexes if col and v["column"].lower() == col.lower() and v["metric"] == metric[0]]
            if found:
                return f"VectorSearch {min(found, key=lambda v: v['id'])['name']}"
    w = q.where
    if w is not None and not w.negated:
        tests = list(w.args) if w.op == "between" else [w]
        col = None
        for t in tests:
            if t.op not in ("=", "<", "<=", ">", ">=") or sum(a.op == "column" for a in t.args) != 1:
                return "SeqScan"
            other = next(a for a in t.args if a.op != "column")
            if not other.constant or other.type.name in ("NULL", "VECTOR"):
                return "SeqScan"
            col = next(a.value for a in t.args if a.op == "column")
        found = [i for i in indexes if i["column"].lower() == col.lower()]
        if found:
            return f"IndexScan {'Equal' if w.op == '=' else 'Range'} {min(found, key=lambda i: i['id'])['name']}"
    return "SeqScan"
