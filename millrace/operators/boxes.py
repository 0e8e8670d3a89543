"""Boxes on pages, in coordinates of 0 to 1000."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(box: Column, width: Column, height: Column) -> Column:
    """x by width, y by height, in thousandths rounded down; boxes that have not four values, and pages without a size,
    leave the box as it is."""
    ok = (F.size(box) == 4) & (width > 0) & (height > 0)
    return F.when(ok, F.transform(box, lambda v, i: F.floor(v * 1000 / F.when(i % 2 == 0, width).otherwise(height)).cast("int"))).otherwise(box)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes whose edges count as pixels."""
    side = lambda p, q, i: F.greatest(F.lit(0), F.least(p[i + 2], q[i + 2]) - F.greatest(p[i], q[i]) + 1)
    area = lambda p: (p[2] - p[0] + 1) * (p[3] - p[1] + 1)
    inter = side(a, b, 0) * side(a, b, 1)
    return inter / (area(a) + area(b) - inter)


def contained(a: Column, b: Column) -> Column:
    """The share of box a that lies in box b."""
    side = lambda i: F.greatest(F.lit(0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1) / F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(1))


def suppressed(df: DataFrame, page: str, key: str, label: str, score: str, box: str, same: float = 0.6, other: float = 0.98) -> DataFrame:
    """(page, key) of the boxes that remain on each page: best first, without those that overlap a kept one too much. A
    page's boxes are folded by one task."""
    src = df.select(page, key, label, score, box)
    kind = src.schema

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([(score, "descending"), (key, "ascending")])
        labels, boxes = t.column(label).to_pylist(), t.column(box).to_pylist()
        kept: list[int] = []
        for i, b in enumerate(boxes):
            for j in kept:
                c = boxes[j]
                w, h = max(0, min(b[2], c[2]) - max(b[0], c[0]) + 1), max(0, min(b[3], c[3]) - max(b[1], c[1]) + 1)
                union = (b[2] - b[0] + 1) * (b[3] - b[1] + 1) + (c[2] - c[0] + 1) * (c[3] - c[1] + 1) - w * h
                if w * h / union >= (same if labels[i] == labels[j] else other):
                    break
            else:
                kept.append(i)
        return t.select([page, key]).take(pa.array(kept, pa.int32()))

    return src.groupBy(page).applyInArrow(fold, f"`{page}` {kind[page].dataType.simpleString()}, `{key}` {kind[key].dataType.simpleString()}")
