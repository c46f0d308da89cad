"""Display labels of a category: levels, code maps, palette matching, row relabelling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from statweave.plans.common import levels_of, natural_order, ratio
from statweave.plans.order import numbered

c = F.col


def label_levels(df: DataFrame, col: str) -> DataFrame:
    """value, n, ratio and a default code by frequency (ties by value).

    Levels are numbered by ranges of (n, value), so no task sees all levels, or all that occur once."""
    counts = df.select(c(col).cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return numbered(counts, [c("n").desc(), c("value")]).select("value", "n", ratio(c("n"), total).alias("ratio"), c("_g").cast("int").alias("code"))


def label_code(col: str, mapping: dict[str, str]) -> Column:
    """Code of each value, the value itself when unmapped."""
    txt = c(col).cast("string")
    if not mapping:
        return txt
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(str(v)))])
    return F.coalesce(table[txt], txt)


def apply_label_maps(df: DataFrame, maps: dict[str, dict]) -> DataFrame:
    return df.withColumns({col: label_code(col, m) for col, m in maps.items() if m})


def merged_groups(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Groups after mapping: code, source values, size."""
    lv = df.select(c(col).cast("string").alias("value")).where("value is not null") \
           .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return lv.select(label_code("value", mapping).alias("code"), "value", "n").groupBy("code").agg(
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"), F.sum("n").alias("n"))


def normalise_label(col: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(col.cast("string")), "[^\\p{L}\\p{N}]", "")


def palette_match(df: DataFrame, col: str, palette: DataFrame) -> DataFrame:
    """Category of each distinct label by its longest contained keyword; ``ambiguous`` when two
    categories tie.  ``palette`` holds (keyword, category) and is a curated dictionary.

    Labels meet keywords through the keyword's text: every substring of a label with a length
    that occurs among the keywords is a join key, so no label-by-keyword product is formed."""
    words = palette.select(normalise_label(c("keyword")).alias("_w"), "category").where("_w <> ''").distinct()
    lengths = sorted(r[0] for r in words.select(F.length("_w")).distinct().collect())       # at most the longest keyword's length
    labels = df.select(c(col).cast("string").alias("label")).where("label is not null").groupBy("label") \
               .agg(F.count(F.lit(1)).alias("n")).withColumn("_t", normalise_label(c("label")))
    if not lengths:
        return labels.select("label", "n", F.lit(None).cast("string").alias("category"), F.lit(False).alias("ambiguous"))

    def windows(k: Column) -> Column:
        starts = F.when(F.length("_t") >= k, F.sequence(F.lit(1), F.length("_t") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(c("_t"), i, k))

    pieces = F.flatten(F.transform(F.array(*map(F.lit, lengths)), windows))
    keyed = labels.select("label", "n", F.explode_outer(F.array_distinct(pieces)).alias("_w"))
    hit = keyed.join(words, "_w", "left")
    per = hit.groupBy("label", "n", "category").agg(F.max(F.length("_w")).alias("_len")).where("category is not null")
    best = per.groupBy("label").agg(F.max("_len").alias("_best"))
    win = per.join(best, "label").where("_len = _best").groupBy("label").agg(
        F.min("category").alias("category"), (F.count(F.lit(1)) > 1).alias("ambiguous"))
    return labels.join(win, "label", "left").select(
        "label", "n", "category", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def ordered_levels(df: DataFrame, col: str, limit: int = 1000) -> list[str]:
    """Levels in natural order (T1 < T2 < T10; numbers by value)."""
    return levels_of(df, col, limit)


def order_key(col: Column) -> Column:
    """Sortable form of the natural order."""
    return natural_order(col)


# ------------------------------------------------------------------ cell edits by key
def relabel(df: DataFrame, key: str, col: str, edits: DataFrame) -> DataFrame:
    """Overwrite ``col`` for keys in ``edits`` (key, value, note); the row keeps what it was."""
    e = edits.select(c("key").cast("string").alias("_k"), c("value").alias("_value"), c("note").alias("_relabel_note"))
    out = df.join(e, c(key).cast("string") == c("_k"), "left")
    hit = c("_k").isNotNull()
    kind = df.schema[col].dataType
    return (out.withColumn("_relabeled", hit)
               .withColumn("_relabel_from", F.when(hit, c(col).cast("string")))
               .withColumn(col, F.when(hit, c("_value").cast(kind)).otherwise(c(col))).drop("_k", "_value"))


def relabel_ratio(df: DataFrame, limit: float = 0.01) -> DataFrame:
    n = F.sum(c("_relabeled").cast("long"))
    return df.agg(n.alias("relabeled"), F.count(F.lit(1)).alias("total")).select(
        "*", ratio(c("relabeled"), c("total")).alias("ratio"),
        (c("relabeled") > limit * c("total")).alias("over_limit"))


def find_row(df: DataFrame, key: str, value, col: str) -> DataFrame:
    return df.where(c(key).cast("string") == F.lit(str(value))).select(key, col)
