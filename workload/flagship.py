"""Flagship slice: overall and per-stratum Welch comparison with direction flips."""
from pyspark.sql import functions as F

from statweave.operators.run import run_test
from statweave.spec import Spec
from workload.registry import query

_CELLS = """
  select coalesce(l_linestatus, 'overall') as stratum,
    count(l_extendedprice) filter (l_returnflag = 'A') n1, avg(l_extendedprice) filter (l_returnflag = 'A') m1,
    var_samp(l_extendedprice) filter (l_returnflag = 'A') v1,
    count(l_extendedprice) filter (l_returnflag = 'R') n2, avg(l_extendedprice) filter (l_returnflag = 'R') m2,
    var_samp(l_extendedprice) filter (l_returnflag = 'R') v2
  from lineitem where l_returnflag in ('A', 'R') group by rollup (l_linestatus)
"""


@query("flagship_price_by_return_flag", f"""
with c as ({_CELLS}), s as (
  select stratum, n1, n2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t,
    (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0 / (4 * (n1 + n2) - 9)) as g from c)
select s.stratum, n1, n2, round(t, 6) as statistic, round(g, 6) as effect,
  (g * (select g from s where stratum = 'overall') < 0) as flipped from s
""")
def price_gap_by_return_flag(t):
    spec = Spec(y="l_extendedprice", group="l_returnflag", by="l_linestatus", levels=("A", "R"))
    r = run_test(t.lineitem, spec, "T-101")
    return r.select("stratum", F.col("n")["A"].alias("n1"), F.col("n")["R"].alias("n2"),
                    F.round("statistic", 6).alias("statistic"), F.round("effect.value", 6).alias("effect"), "flipped")
