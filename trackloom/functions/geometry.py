"""Column expressions for planar geometry: projective maps, boxes, regulation court tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Regulation court, metres, origin at the centre below the net (fixed values).
HALF_WIDTH = 3.05
HALF_LENGTH = 6.70
HALF_SINGLES_WIDTH = 2.59
SHORT_SERVICE = 1.98
LONG_SERVICE_INSET = 0.76
LONG_SERVICE = HALF_LENGTH - LONG_SERVICE_INSET

H = tuple(f"h{i}" for i in range(9))  # row-major image-to-court matrix columns
TINY = 1e-12


def court_landmark_rows() -> list[tuple[str, float, float]]:
    """The 32 named line intersections, as (name, x, y)."""
    sides = {"left": -1.0, "right": 1.0}
    rows = []
    for side, sx in sides.items():
        for suffix, half in (("", HALF_WIDTH), ("_singles", HALF_SINGLES_WIDTH)):
            rows.append((f"net_{side}{suffix}", sx * half, 0.0))
            for end, sy in (("near", -1.0), ("far", 1.0)):
                rows.append((f"{end}_{side}{suffix or '_doubles'}", sx * half, sy * HALF_LENGTH))
                rows.append((f"{end}_short_service_{side}{suffix}", sx * half, sy * SHORT_SERVICE))
                rows.append((f"{end}_doubles_long_service_{side}{suffix}", sx * half, sy * LONG_SERVICE))
    for end, sy in (("near", -1.0), ("far", 1.0)):
        rows.append((f"{end}_short_service_center", 0.0, sy * SHORT_SERVICE))
        rows.append((f"{end}_doubles_long_service_center", 0.0, sy * LONG_SERVICE))
    return sorted(rows)


def court_line_rows() -> list[tuple[str, str, float]]:
    """The 10 floor lines usable for calibration, as (name, constant axis, value in metres)."""
    rows = [(f"{side}_{kind}_sideline", "x", sx * half)
            for side, sx in (("left", -1.0), ("right", 1.0))
            for kind, half in (("doubles", HALF_WIDTH), ("singles", HALF_SINGLES_WIDTH))]
    rows += [(f"{end}_{line}", "y", sy * at)
             for end, sy in (("near", -1.0), ("far", 1.0))
             for line, at in (("baseline", HALF_LENGTH), ("doubles_long_service", LONG_SERVICE),
                              ("short_service", SHORT_SERVICE))]
    return sorted(rows)


def court_segment_rows() -> list[tuple[float, float, float, float]]:
    """Every painted marking as (x1, y1, x2, y2)."""
    across = [-HALF_LENGTH, -LONG_SERVICE, -SHORT_SERVICE, 0.0, SHORT_SERVICE, LONG_SERVICE, HALF_LENGTH]
    along = [-HALF_WIDTH, -HALF_SINGLES_WIDTH, HALF_SINGLES_WIDTH, HALF_WIDTH]
    return ([(-HALF_WIDTH, y, HALF_WIDTH, y) for y in across]
            + [(x, -HALF_LENGTH, x, HALF_LENGTH) for x in along]
            + [(0.0, -HALF_LENGTH, 0.0, -SHORT_SERVICE), (0.0, SHORT_SERVICE, 0.0, HALF_LENGTH)])


def literal_rows(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """A fixed table as one array literal, to be attached with ``F.inline``."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def determinant(h=H) -> Column:
    a, b, c, d, e, f, g, i, j = map(F.col, h)
    return a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)


def scaled_matrix(columns) -> list[Column]:
    """Divide a 3x3 matrix by its last element, or by its norm where that vanishes."""
    cs = list(columns)
    norm = F.sqrt(sum((c * c for c in cs[1:]), cs[0] * cs[0]))
    scale = F.when(F.abs(cs[8]) < TINY, norm).otherwise(cs[8])
    return [c / scale for c in cs]


def adjugate_matrix(h=H) -> list[Column]:
    a, b, c, d, e, f, g, i, j = map(F.col, h)
    return [e * j - f * i, c * i - b * j, b * f - c * e,
            f * g - d * j, a * j - c * g, c * d - a * f,
            d * i - e * g, b * g - a * i, a * e - b * d]


def inverse_matrix(h=H) -> list[Column]:
    det = F.nullif(determinant(h), F.lit(0.0))  # a singular matrix has no inverse: all its points are null
    return scaled_matrix([x / det for x in adjugate_matrix(h)])


def with_inverse(df: DataFrame, h=H) -> tuple[DataFrame, list[str]]:
    """``inverse_matrix`` as columns of their own, step by step, and their names: an expression over the whole
    inverse repeats all its parts wherever an element is used, and soon outgrows what Spark compiles."""
    steps, names = [f"adjugate{k}" for k in range(9)], [f"inverse{k}" for k in range(9)]
    det = F.nullif(determinant(h), F.lit(0.0))  # a singular matrix has no inverse: all its points are null
    rows = df.withColumn("adjugate_det", det)
    rows = rows.withColumns({n: x / F.col("adjugate_det") for n, x in zip(steps, adjugate_matrix(h))})
    rows = rows.withColumns(dict(zip(names, scaled_matrix(map(F.col, steps)))))
    return rows.drop("adjugate_det", *steps), names


def project(x: Column, y: Column, matrix) -> tuple[Column, Column]:
    """Apply a projective map; points at (or near) infinity give NULL."""
    m = [F.col(c) if isinstance(c, str) else c for c in matrix]
    w = m[6] * x + m[7] * y + m[8]
    finite = F.abs(w) >= TINY
    return (F.when(finite, (m[0] * x + m[1] * y + m[2]) / w),
            F.when(finite, (m[3] * x + m[4] * y + m[5]) / w))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two [x1, y1, x2, y2] arrays; 0 for empty unions."""
    side = lambda box, lo, hi: F.greatest(F.lit(0.0), box[hi] - box[lo])
    inner = (F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
             * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1])))
    union = side(a, 0, 2) * side(a, 1, 3) + side(b, 0, 2) * side(b, 1, 3) - inner
    return F.when(union > 0, inner / union).otherwise(F.lit(0.0))
