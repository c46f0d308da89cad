"""Shared expressions: clean numerics, ordered levels, the result row, lineage cuts."""
from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Grouping columns are categories; more distinct values than this is not a category.
MAX_LEVELS = 1000


def num(c) -> Column:
    """Column as double with NaN folded into null (Spark keeps the two apart)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def ratio(a, b) -> Column:
    """a / b, null where b is 0 (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b if isinstance(b, Column) else F.lit(b))


def sq(c: Column) -> Column:
    return c * c


#: fixed values: date layouts of the natural order (groups: year, month, day)
DATE_ORDERS = ((r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)), (r"^(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", (3, 2, 1)))
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def natural_key(value) -> tuple:
    """Numbers by size, then dates by day, then text: T1 < T2 < T10, upper and lower case alike. `natural_order` is the same as a column."""
    text = str(value).strip()
    if re.match(NUMBER, text):
        return (0, float(text), "", text)
    for pattern, (y, m, d) in DATE_ORDERS:
        if hit := re.match(pattern, text):
            return (1, 0.0, f"{hit[y]}-{hit[m]:0>2}-{hit[d]:0>2}" + text[hit.end():], text)
    chunks = [f"{len(x.lstrip('0')):010d}{x.lstrip('0')}" if x.isdigit() else x.lower() for x in re.findall(r"[0-9]+|[^0-9]+", text)]
    return (2, 0.0, "".join(chunks), text)


def natural_order(col: Column) -> Column:
    """Sortable struct of a value's natural order: a digit run of any length is its length without leading zeros, then its digits."""
    text = F.trim(col.cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    part = lambda pattern, k: F.lpad(F.regexp_extract(text, pattern, k), 2, "0")
    day = F.coalesce(*[F.when(text.rlike(p), F.concat(F.regexp_extract(text, p, y), F.lit("-"), part(p, m), F.lit("-"), part(p, d), F.regexp_replace(text, p, ""))) for p, (y, m, d) in DATE_ORDERS])
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    pieces = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)")), lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))).otherwise(F.lower(x)))
    kind = F.when(number.isNotNull(), 0).when(day.isNotNull(), 1).otherwise(2)
    return F.when(text.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(number, F.lit(0.0)).alias("number"),
                                             F.when(kind == 0, "").when(kind == 1, day).otherwise(F.array_join(pieces, "")).alias("text"), text.alias("value")))


def levels_of(df: DataFrame, col: str, limit: int = MAX_LEVELS) -> list[str]:
    """Distinct levels of a category as text in natural order; refuses unbounded columns."""
    rows = df.select(F.col(col).cast("string").alias("v")).where("v is not null") \
             .distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"column {col!r} has more than {limit} levels; not a grouping column")
    return sorted((r["v"] for r in rows), key=natural_key)


def two_levels(df: DataFrame, group: str, levels: Sequence[str] | None = None) -> list[str]:
    found = [str(v) for v in levels] if levels else levels_of(df, group)
    if len(found) != 2:
        raise ValueError(f"need exactly two groups in {group!r}, found {len(found)}")
    return found


def result(df: DataFrame, test_id: str, *, by: Sequence[str] = (), statistic=None, p=None,
           effect=None, effect_name: str = "", ci=(None, None), n: dict | None = None,
           numbers: dict | None = None) -> DataFrame:
    """Uniform outcome row(s): one per stratum, everything the question needs to be read."""
    dbl = lambda c: (F.lit(None) if c is None else c).cast("double")

    def as_map(d, typ):
        if not d:
            return F.expr(f"cast(map() as map<string,{typ}>)")
        return F.create_map(*[x for k, c in d.items() for x in (F.lit(k), c.cast(typ))])

    return df.select(
        *by, F.lit(test_id).alias("test_id"), dbl(statistic).alias("statistic"),
        dbl(p).alias("p"),
        F.struct(F.lit(effect_name).alias("name"), dbl(effect).alias("value"),
                 dbl(ci[0]).alias("ci_low"), dbl(ci[1]).alias("ci_high")).alias("effect"),
        as_map(n, "bigint").alias("n"), as_map(numbers, "double").alias("numbers"))


def flat(res: DataFrame, numbers: Sequence[str] = (), by: Sequence[str] = (),
         digits: int = 6) -> DataFrame:
    """Outcome rows as plain rounded columns (reports, oracle comparison)."""
    return res.select(*by, F.round("statistic", digits).alias("statistic"),
                      F.round("effect.value", digits).alias("effect"),
                      *[F.round(F.col("numbers")[k], digits).alias(k) for k in numbers])


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder the cluster names in ``spark.checkpoint.dir``.  Only a
    local session without that setting (tests) falls back to a folder of its own.

    A checkpoint keeps the planner's estimate of its size, and that of a join is the product of its sides: carried from
    round to round the number itself would fill the driver. Beyond 63 bits it is dropped with the rest of the plan."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="statweave-checkpoint-"))
        else:
            raise RuntimeError("iterative fits need spark.checkpoint.dir to name a shared folder")
    kept = df.checkpoint()
    if kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 1 << 63:
        kept = DataFrame(df.sparkSession._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), df.sparkSession)
    return kept


def beside(rows: DataFrame, groups: DataFrame, by: Sequence[str], names: Sequence[str] | None = None, few: int = MAX_LEVELS) -> DataFrame:
    """``rows`` with the columns of ``groups``, a table of one row per value of ``by`` (there called ``names``), matched null-safely.

    A join by few keys sends all rows of a key to one task. So the groups are written and counted: at most ``few`` of them are
    broadcast and the rows stay where they are; of more, rows and groups meet by key."""
    names = list(names or by)
    g = cut_lineage(groups.withColumnsRenamed({n: f"_g_{b}" for n, b in zip(names, by)}))
    if g.limit(few + 1).count() <= few:
        g = F.broadcast(g)
    return rows.join(g, [rows[b].eqNullSafe(g[f"_g_{b}"]) for b in by]).drop(*[f"_g_{b}" for b in by])


def fisher_z_ci(r: Column, n: Column) -> tuple[Column, Column]:
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)))
    half = 1.96 / F.sqrt(F.greatest(F.lit(4.0), n.cast("double")) - 3)
    return F.tanh(z - half), F.tanh(z + half)
