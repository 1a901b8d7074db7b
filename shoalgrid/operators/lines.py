"""Lines (line_id, seq, x, y) and rings: splitting, resampling, simplifying, areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _along():
    return Window.partitionBy("line_id").orderBy("seq")


def split(lines: DataFrame, max_verts: int) -> DataFrame:
    """(line_id, part, seq, x, y): pieces of ``max_verts`` vertices that share their ends."""
    step = max_verts - 1
    last = F.max("seq").over(Window.partitionBy("line_id"))
    part = F.floor(F.col("seq") / step)
    joint = (F.col("seq") % step == 0) & (F.col("seq") > 0)
    parts = F.when(joint & (F.col("seq") < F.col("_last")), F.array(part - 1, part)).when(joint, F.array(part - 1)).otherwise(F.array(part))
    return lines.withColumn("_last", last).withColumn("part", F.explode(parts)).select("line_id", F.col("part").cast("long").alias("part"), "seq", "x", "y")


def segments(lines: DataFrame) -> DataFrame:
    """(line_id, seq, x1, y1, x2, y2): consecutive vertices."""
    nxt = lambda c: F.lead(c).over(_along())
    return lines.select("line_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2")).where("x2 is not null")


def lengths(lines: DataFrame) -> DataFrame:
    """Add d, the length along the line up to each vertex."""
    step = F.hypot(F.col("x") - F.lag("x").over(_along()), F.col("y") - F.lag("y").over(_along()))
    return lines.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("d", F.sum("_s").over(_along())).drop("_s")


def resample(lines: DataFrame, target: float) -> DataFrame:
    """(line_id, k, x, y): points every ``target`` along the line, and its end; shorter lines keep their vertices."""
    m = lengths(lines)
    total = F.max("d").over(Window.partitionBy("line_id"))
    seg = m.withColumn("total", total).withColumn("x2", F.lead("x").over(_along())).withColumn("y2", F.lead("y").over(_along())).withColumn("d2", F.lead("d").over(_along()))
    short = seg.where(F.col("total") < target).select("line_id", F.col("seq").cast("long").alias("k"), "x", "y")
    long = seg.where((F.col("total") >= target) & F.col("x2").isNotNull() & (F.col("d2") > F.col("d")))
    first = F.ceil(F.col("d") / target)
    # a point at a joint belongs to the segment that starts there, the end of the line to its last point
    ks = F.filter(F.sequence(first, F.greatest(first, F.floor(F.col("d2") / target))), lambda k: (k * target >= F.col("d")) & (k * target < F.col("d2")))
    inner = long.withColumn("k", F.explode(ks)).withColumn("t", (F.col("k") * target - F.col("d")) / (F.col("d2") - F.col("d")))
    inner = inner.select("line_id", F.col("k").cast("long").alias("k"), (F.col("x") + F.col("t") * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + F.col("t") * (F.col("y2") - F.col("y"))).alias("y"))
    end = seg.where(F.col("x2").isNull() & (F.col("total") >= target)).select("line_id", F.ceil(F.col("total") / target).cast("long").alias("k"), "x", "y")
    return short.unionByName(inner).unionByName(end)


def redistribute(lines: DataFrame, distance: float) -> DataFrame:
    """(line_id, k, x, y): every line in round(length / distance) equal parts, one at least; lines without length stay out."""
    m = lengths(lines)
    total = F.max("d").over(Window.partitionBy("line_id"))
    seg = m.withColumn("total", total).withColumn("x2", F.lead("x").over(_along())).withColumn("y2", F.lead("y").over(_along())).withColumn("d2", F.lead("d").over(_along()))
    seg = seg.withColumn("parts", F.greatest(F.lit(1), F.floor(F.col("total") / distance + 0.5))).withColumn("step", F.col("total") / F.col("parts"))
    inner = seg.where(F.col("x2").isNotNull() & (F.col("d2") > F.col("d")))
    first = F.greatest(F.lit(0).cast("long"), F.floor(F.col("d") / F.col("step")) - 1)
    ks = F.filter(F.sequence(first, F.floor(F.col("d2") / F.col("step")) + 1), lambda k: (k * F.col("step") >= F.col("d")) & (k * F.col("step") < F.col("d2")) & (k < F.col("parts")))
    inner = inner.withColumn("k", F.explode(ks)).withColumn("t", (F.col("k") * F.col("step") - F.col("d")) / (F.col("d2") - F.col("d")))
    inner = inner.select("line_id", F.col("k").cast("long").alias("k"), (F.col("x") + F.col("t") * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + F.col("t") * (F.col("y2") - F.col("y"))).alias("y"))
    end = seg.where(F.col("x2").isNull() & (F.col("total") > 0)).select("line_id", F.col("parts").cast("long").alias("k"), "x", "y")
    return inner.unionByName(end)


def simplify_collinear(lines: DataFrame) -> DataFrame:
    """Without repeated vertices and those between collinear neighbours; ends stay."""
    x, y = F.col("x"), F.col("y")
    same = (x == F.lag("x").over(_along())) & (y == F.lag("y").over(_along()))
    kept = lines.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same")
    px, py, nx, ny = F.lag("x").over(_along()), F.lag("y").over(_along()), F.lead("x").over(_along()), F.lead("y").over(_along())
    cross = (x - px) * (ny - y) - (y - py) * (nx - x)
    ahead = (x - px) * (nx - x) + (y - py) * (ny - y) > 0
    return kept.withColumn("_drop", F.coalesce((cross == 0) & ahead, F.lit(False))).where("not _drop").drop("_drop")


def ring_areas(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Signed shoelace area of rings (keys, seq, x, y), not closed by a repeated vertex."""
    w = Window.partitionBy(*keys).orderBy("seq")
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in ("x", "y"))
    terms = rings.withColumn("_t", F.col("x") * ny - nx * F.col("y"))
    return terms.groupBy(*keys).agg((F.sum("_t") / 2).alias("area"))


def remove_holes(rings: DataFrame) -> DataFrame:
    return rings.where("ring_type = 'exterior'")


def remove_small_holes(rings: DataFrame, rel_size: float = 0.1) -> DataFrame:
    """Rings (poly_id, ring, ring_type, area) without holes whose share of the polygon's net area is ``rel_size`` or less."""
    w = Window.partitionBy("poly_id")
    signed = F.when(F.col("ring_type") == "exterior", F.abs("area")).otherwise(-F.abs("area"))
    return rings.withColumn("_net", F.sum(signed).over(w)).where((F.col("ring_type") == "exterior") | (F.abs("area") / F.col("_net") > rel_size)).drop("_net")


def overlapping_boxes(boxes: DataFrame, size: float = 4.0) -> DataFrame:
    """(a, b) of boxes with touching or overlapping extents, a < b."""
    from ..plans.spatial import boxes_of

    one = boxes_of(boxes, size)
    two = one.select(*[F.col(c).alias(f"_{c}") if c != "_b" else F.col(c) for c in one.columns])
    met = (F.col("poly_id") < F.col("_poly_id")) & (F.col("x0") <= F.col("_x1")) & (F.col("_x0") <= F.col("x1")) & (F.col("y0") <= F.col("_y1")) & (F.col("_y0") <= F.col("y1"))
    return one.join(two, "_b").where(met).select(F.col("poly_id").alias("a"), F.col("_poly_id").alias("b")).distinct()
