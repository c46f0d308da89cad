import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")       # before numpy loads: threaded BLAS stalls beside the JVM here

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
import pytest  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("statweave-tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def buckets(spark):
    """Forces the many-bucket plans on small data."""
    spark.conf.set("statweave.rowsPerBucket", "40")
    yield
    spark.conf.unset("statweave.rowsPerBucket")


@pytest.fixture(scope="session")
def table(spark):
    """400 rows: two arms, three doses, skew, ties, counts, a survival pair, gaps."""
    r = np.random.default_rng(7)
    n = 400
    arm = np.where(np.arange(n) % 2 == 0, "A", "B")
    dose = (np.arange(n) % 3).astype(int)
    x = r.normal(size=n)
    y = 1.0 + 0.8 * x + 0.5 * (arm == "A") + r.normal(size=n)
    t = r.exponential(np.exp(-0.5 * x), size=n).round(2) + 0.01
    pdf = pd.DataFrame({
        "id": np.arange(n), "arm": arm, "dose": dose, "x": x, "y": y, "tied": np.round(y).astype(float), "count": r.poisson(np.exp(0.3 + 0.4 * x)),
        "over": r.negative_binomial(1.5, 1.5 / (1.5 + np.exp(1 + 0.3 * x))), "bin": (r.random(n) < 1 / (1 + np.exp(-0.7 * x))).astype(int),
        "ord": np.digitize(y, [0.3, 1.2, 2.2]), "time": t, "event": (r.random(n) < 0.7).astype(int),
        "unit": np.clip(1 / (1 + np.exp(-(0.4 * x + r.normal(size=n) * 0.6))), 0.001, 0.999), "subject": np.arange(n) // 4, "visit": [f"T{i % 4 + 8}" for i in range(n)]})
    return pdf, spark.createDataFrame(pdf).repartition(5).persist()
