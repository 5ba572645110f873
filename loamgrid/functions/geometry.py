"""Geometry as column expressions: parts, bounding boxes, predicates against a query box.

All comparisons are closed on both ends and made on doubles widened from the stored floats. Every
function unrolls the dimensions when the plan is built, so expressions stay inside code generation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.plans.schema import AnnotationSchema

Box = tuple[Sequence[float], Sequence[float]]


def check_box(lower: Sequence[float], upper: Sequence[float], rank: int) -> Box:
    """The box as floats; ``ValueError`` for wrong lengths, non-finite or inverted bounds."""
    lower, upper = [float(x) for x in lower], [float(x) for x in upper]
    if len(lower) != rank or len(upper) != rank:
        raise ValueError(f"bounds need {rank} entries, got {len(lower)} and {len(upper)}")
    if not all(map(math.isfinite, lower + upper)):
        raise ValueError("bounds must be finite")
    if any(a > b for a, b in zip(lower, upper)):
        raise ValueError(f"lower bound {lower} exceeds upper bound {upper}")
    return lower, upper


def entry(part: str | Column, d: int) -> Column:
    """Dimension ``d`` of a vector column, as double."""
    return F.get(F.col(part) if isinstance(part, str) else part, F.lit(d)).cast("double")


def split(flat: Column, schema: AnnotationSchema) -> dict[str, Column]:
    """Named parts of a flat geometry vector."""
    r = schema.rank
    return {p: F.slice(flat, i * r + 1, r) for i, p in enumerate(schema.parts)}


def flatten(schema: AnnotationSchema) -> Column:
    return F.concat(*[F.col(p) for p in schema.parts])


def box_bounds(schema: AnnotationSchema) -> tuple[list[Column], list[Column]]:
    """Lower and upper corner of each annotation's bounding box."""
    first, second = schema.parts[0], schema.parts[-1]
    low, high = [], []
    for d in range(schema.rank):
        a, b = entry(first, d), entry(second, d)
        if schema.annotation_type == "ellipsoid":
            a, b = a - b, a + b
        low.append(F.least(a, b))
        high.append(F.greatest(a, b))
    return low, high


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def point_in(part: str, box: Box) -> Column:
    return _all([entry(part, d).between(lo, hi) for d, (lo, hi) in enumerate(zip(*box))])


def in_box(schema: AnnotationSchema, box: Box) -> Column:
    """The plain predicate of each type: a point or center inside; an end of a line inside; a corner of
    a box inside or the box, its corners in like order in all dimensions, around the query."""
    if schema.annotation_type in ("point", "ellipsoid"):
        return point_in(schema.parts[0], box)
    a, b = schema.parts
    found = point_in(a, box) | point_in(b, box)
    if schema.annotation_type == "axis_aligned_bounding_box":
        for first, second in ((a, b), (b, a)):
            found = found | _all([(entry(first, d) <= lo) & (entry(second, d) >= hi) for d, (lo, hi) in enumerate(zip(*box))])
    return found


def overlaps(schema: AnnotationSchema, box: Box) -> Column:
    """Bounding box against query box: what every predicate implies."""
    low, high = box_bounds(schema)
    return _all([(h >= lo) & (l <= hi) for l, h, lo, hi in zip(low, high, *box)])


def intersects(schema: AnnotationSchema, box: Box) -> Column:
    """True geometric intersection: boxes overlap, a line's segment crosses the query, an ellipsoid
    holds the query point nearest to its center (in units of its radii)."""
    kind = schema.annotation_type
    if kind == "point":
        return in_box(schema, box)
    if kind == "axis_aligned_bounding_box":
        return overlaps(schema, box)
    if kind == "ellipsoid":
        total = F.lit(0.0)
        for d, (lo, hi) in enumerate(zip(*box)):
            c, r = entry("center", d), F.abs(entry("radii", d))
            gap = F.greatest(F.lit(lo) - c, c - F.lit(hi), F.lit(0.0))
            total = total + F.when(gap == 0, 0.0).when(r == 0, float("inf")).otherwise(gap * gap / (r * r))
        return total <= 1
    # slabs: the segment's parameters inside each dimension's range must have a common value
    enter, leave, apart = [F.lit(0.0)], [F.lit(1.0)], []
    for d, (lo, hi) in enumerate(zip(*box)):
        a, b = entry("point_a", d), entry("point_b", d)
        flat, step = a == b, b - a
        t, u = (F.lit(lo) - a) / F.nullif(step, F.lit(0.0)), (F.lit(hi) - a) / F.nullif(step, F.lit(0.0))
        enter.append(F.coalesce(F.least(t, u), F.lit(0.0)))
        leave.append(F.coalesce(F.greatest(t, u), F.lit(1.0)))
        apart.append(~flat | a.between(lo, hi))
    return _all(apart) & (F.greatest(*enter) <= F.least(*leave))
