"""Exact bin assignment as column arithmetic (J3 and the equal-width rules).

Range lookups are never non-equi joins: a value is placed by comparing it with
a short edge array carried on the row (broadcast per feature), or by
arithmetic on equal-width edges followed by a one-step correction against the
exact edge values, so the result equals the comparison rule bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_below(value, edges, max_edges: int, strict: bool = True) -> Column:
    """Number of elements of the sorted array ``edges`` that are < value (``<=`` if not strict).

    Unrolled over at most ``max_edges`` positions with ``try_element_at`` so the
    expression stays in generated code (no lambda evaluation per row).
    """
    v = _c(value)
    arr = _c(edges)
    terms = []
    for i in range(1, max_edges + 1):
        e = F.try_element_at(arr, F.lit(i))
        cmp = (e < v) if strict else (e <= v)
        terms.append(F.coalesce(cmp, F.lit(False)).cast("int"))
    if not terms:
        return F.lit(0)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def right_closed_bin(value, inner_edges, max_edges: int) -> Column:
    """Bin of (e_j, e_{j+1}] with -inf/+inf outer edges = number of inner edges < value.

    NULL values map to NULL (the caller adds a separate missing bucket).
    """
    v = _c(value)
    return F.when(v.isNotNull(), count_below(v, inner_edges, max_edges, strict=True))


def linspace_edge(lo, step, i) -> Column:
    """Edge i of ``numpy.linspace(lo, hi, n + 1)`` = i * step + lo with step = (hi - lo) / n."""
    i_c = i if isinstance(i, Column) else F.lit(i)
    return i_c.cast("double") * step + lo


def equal_width_right_closed(value, lo, hi, n: int) -> Column:
    """Bin 0..n-1 of ``pd.cut(x, n)``: right-closed bins on linspace edges.

    Count of inner edges e_1..e_{n-1} strictly below the value, computed as
    ceil((x-lo)/step)-1 and corrected by one step against the exact edges.
    """
    v, lo_c, hi_c = _c(value), _c(lo), _c(hi)
    step = (hi_c - lo_c) / F.lit(float(n))
    guess = F.ceil((v - lo_c) / step).cast("int") - F.lit(1)
    c = F.least(F.greatest(guess, F.lit(0)), F.lit(n - 1))
    up = F.when((c + 1 <= n - 1) & (linspace_edge(lo_c, step, c + 1) < v), c + 1).otherwise(c)
    fixed = F.when((up >= 1) & (linspace_edge(lo_c, step, up) >= v), up - 1).otherwise(up)
    return F.when(v.isNotNull(), F.when(hi_c == lo_c, F.lit(0)).otherwise(fixed))


def equal_width_left_closed(value, lo, hi, n: int) -> Column:
    """Bin 0..n-1 of ``numpy.histogram(x, n, range=(lo, hi))``: left-closed, last bin closed.

    Values outside [lo, hi] give NULL (numpy ignores them).
    """
    v, lo_c, hi_c = _c(value), _c(lo), _c(hi)
    step = (hi_c - lo_c) / F.lit(float(n))
    guess = F.floor((v - lo_c) / step).cast("int")
    c = F.least(F.greatest(guess, F.lit(0)), F.lit(n - 1))
    down = F.when((c >= 1) & (v < linspace_edge(lo_c, step, c)), c - 1).otherwise(c)
    fixed = F.when((down + 1 <= n - 1) & (v >= linspace_edge(lo_c, step, down + 1)), down + 1).otherwise(down)
    inside = v.isNotNull() & (v >= lo_c) & (v <= hi_c)
    return F.when(inside, F.when(hi_c == lo_c, F.lit(0)).otherwise(fixed))
