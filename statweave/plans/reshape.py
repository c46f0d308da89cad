"""Subject x occasion tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from statweave.plans.common import levels_of, num


def subject_by_occasion(df: DataFrame, subject: str, occasion: str, y, levels: Sequence[str] | None = None,
                        by: Sequence[str] = (), numeric: bool = True) -> tuple[DataFrame, list[str], list[str]]:
    """One row per complete subject with columns o0..ok (mean of repeats, or the smallest text
    value); conditional aggregates instead of ``pivot`` keep it one shuffle with partials."""
    levels = [str(v) for v in levels] if levels else levels_of(df, occasion)
    if len(levels) < 2:
        raise ValueError("need at least two occasions")
    val = num(y) if numeric else F.col(y).cast("string")
    occ = F.col(occasion).cast("string")
    cols = [f"o{i}" for i in range(len(levels))]
    agg = F.avg if numeric else F.min
    wide = (df.where(F.col(subject).isNotNull())
              .select(*by, F.col(subject).alias("_subject"), occ.alias("_occ"), val.alias("_y"))
              .groupBy(*by, "_subject")
              .agg(*[agg(F.when(F.col("_occ") == lv, F.col("_y"))).alias(c) for c, lv in zip(cols, levels)]))
    return wide.dropna(subset=cols), cols, levels
