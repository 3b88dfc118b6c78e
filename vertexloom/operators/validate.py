"""Comparison of kernel results and stored graphs with what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph


class ValidationError(AssertionError):
    """A result is not what was expected; ``errors`` has some of the rows."""

    def __init__(self, errors: list):
        super().__init__(f"{len(errors)} errors or more: {errors[:3]}")
        self.errors = errors


def _sides(result: DataFrame, expected: DataFrame) -> DataFrame:
    """``(id, result, expected)`` of all ids of either side; each side is ``(id, value)``."""
    r = result.toDF("id", "result").withColumn("_r", F.lit(True))
    e = expected.toDF("id", "expected").withColumn("_e", F.lit(True))
    return r.join(e, "id", "full_outer")


def exact_mismatches(result: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that are missing, too many or not equal."""
    both = _sides(result, expected)
    return both.where("_r is null or _e is null or not (result <=> expected)").select("id", "result", "expected")


def epsilon_mismatches(result: DataFrame, expected: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """Rows that are missing, too many or off by more than a share; infinity only equals itself."""
    both = _sides(result, expected)
    r, e = F.col("result"), F.col("expected")
    infinite = (F.abs(r) == float("inf")) | (F.abs(e) == float("inf")) | F.isnan(r) | F.isnan(e)
    off = F.when(infinite, ~(r.eqNullSafe(e))).otherwise(F.abs(r - e) > epsilon * F.greatest(F.abs(e), F.lit(1e-300)))
    bad = F.col("_r").isNull() | F.col("_e").isNull() | F.coalesce(off, F.lit(True))
    return both.where(bad).select("id", "result", "expected")


def equivalence_mismatches(result: DataFrame, expected: DataFrame) -> DataFrame:
    """Labels that are not renamed one to one: ``(side, label, n)``, and ids that one side lacks as ``missing``."""
    both = _sides(result, expected)
    whole = both.where("_r and _e")
    pairs = whole.groupBy("result", "expected").agg(F.count("*").alias("_n"))
    forward = pairs.groupBy(F.col("expected").alias("label")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("expected").alias("side"), "label", "n")
    back = pairs.groupBy(F.col("result").alias("label")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("result").alias("side"), "label", "n")
    lost = both.where("_r is null or _e is null").select(F.lit("missing").alias("side"), F.col("id").alias("label"), F.lit(1).cast("long").alias("n"))
    return forward.unionAll(back).unionAll(lost)


def require(mismatches: DataFrame, max_errors: int = 1, report: str | None = None) -> None:
    """Raise if there is any mismatch.

    The error has ``max_errors`` of them at most; with 0 it has their number, and all of them are
    written as JSON to ``report``, which then has to be given: they may be more than a driver holds.
    """
    if max_errors:
        found = mismatches.limit(max_errors).collect()
    elif report is None:
        raise ValueError("all mismatches are asked for, but there is no folder to write them to")
    else:
        mismatches.write.mode("overwrite").json(report)
        n = mismatches.sparkSession.read.schema(mismatches.schema).json(report).count()
        found = [f"{n} mismatches in {report}"] if n else []
    if found:
        raise ValidationError(found)


def update_mismatches(graph: Graph, stream: DataFrame) -> DataFrame:
    """Stream edges ``(src, dst, weight)`` that the graph lacks or has with another weight, from each end that it should have."""
    probes = stream.select("src", "dst", F.col("weight").alias("wanted"))
    if not graph.directed:
        probes = probes.unionAll(probes.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "wanted"))
    arcs = graph.arcs.select("src", "dst", "weight")
    return probes.join(arcs, ["src", "dst"], "left").where("not (weight <=> wanted)").select("src", "dst", "wanted", "weight")


def remap_vertices(one: DataFrame, other: DataFrame) -> DataFrame:
    """``(id, other_id)``: vertices of two datasets in their order; each has ``position`` and ``id``.

    Datasets of unequal size are not the same graph and raise.
    """
    sizes = one.count(), other.count()
    if sizes[0] != sizes[1]:
        raise ValueError(f"{sizes[0]} vertices against {sizes[1]}")
    return one.select("position", "id").join(other.select("position", F.col("id").alias("other_id")), "position").select("id", "other_id")


def relabelled(result: DataFrame, mapping: DataFrame, values_too: bool = False) -> DataFrame:
    """A result ``(id, value)`` with ids, and labels if asked, of the other dataset; a label that is no vertex stays."""
    out = result.toDF("id", "value").join(mapping, "id").select(F.col("other_id").alias("id"), "value")
    if values_too:
        names = mapping.select(F.col("id").alias("value"), F.col("other_id").alias("_v"))
        out = out.join(names, "value", "left").select("id", F.coalesce("_v", "value").alias("value"))
    return out
