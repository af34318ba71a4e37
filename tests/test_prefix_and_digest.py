"""Global prefix sums without a global window, hash trees with proofs, and the Newton fit."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.operators import cohort as co
from marketlens.operators import ledger as lg
from marketlens.operators import stats as st
from marketlens.operators.timeline import prefix_sums


def single_windows(df):
    """Windows whose rows all come to one partition."""
    return re.findall(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", df._jdf.queryExecution().executedPlan().toString())


def test_prefix_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(int(t), i, int(v) if v < 8 else None) for i, (t, v) in enumerate(zip(rng.integers(0, 40, 500), rng.integers(0, 10, 500)))]
    d = prefix_sums(spark.createDataFrame(rows, "ts long, id long, v long"), ["ts", "id"], {"s": F.col("v"), "n": F.lit(1).cast("long")})
    total, want = 0, []
    for k, (t, i, v) in enumerate(sorted(rows)):
        total += v or 0
        want.append((t, i, v, total, k + 1))
    assert sorted(map(tuple, d.collect())) == want
    assert not single_windows(d)
    assert single_windows(d.withColumn("r", F.row_number().over(Window.orderBy("id"))))
    assert prefix_sums(spark.createDataFrame([], "ts long, id long, v long"), ["ts", "id"], {"s": F.col("v")}).collect() == []


def test_split_and_stop_have_no_global_window(spark):
    d = spark.range(1000).select("id", (F.col("id") * 7 % 1000).alias("ts"), F.expr("id % 3 = 0").alias("ok"))
    split = st.chronological_split(d, ["ts", "id"], 0.7)
    assert not single_windows(split) and split.filter("split = 'train'").count() == 700 == split.filter("ts < 700 AND split = 'train'").count()
    assert co.sequential_stop(d, "id", "ok", 5).first()["cutoff"] == 12


@pytest.mark.parametrize("n,leaf", [(0, 4), (3, 4), (4, 4), (300, 4), (300, 4096)])
def test_tree_and_proof(spark, n, leaf):
    members = [f"m{i}" for i in range(n)]
    df = spark.createDataFrame([("g", m) for m in members] * 2 + [(None, "x"), ("g", None)], "g string, m string").repartition(7)
    tree = lg.set_tree(df, ["g"], "m", leaf)
    roots = {r["g"]: r for r in lg.set_digest(df, ["g"], "m", leaf).collect()}
    assert roots[None]["members"] == 1
    if not n:
        assert set(roots) == {None}
        return
    assert roots["g"]["members"] == n
    if n <= leaf:
        assert roots["g"]["digest"] == hashlib.sha256(json.dumps(sorted(members), separators=(",", ":")).encode()).hexdigest()
    for m in (members[0], members[-1]):
        leaf_members, beside = lg.proof(tree, df, {"g": "g"}, "m", m)
        assert len(leaf_members) <= max(4 * leaf, 16) and lg.proof_holds(roots["g"]["digest"], m, leaf_members, beside)
        assert not lg.proof_holds(roots["g"]["digest"], "other", [*leaf_members, "other"], beside) and not lg.proof_holds("0", m, leaf_members, beside)


def test_bound(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "g string, m string")
    d = lg.set_digest(df, ["g"], "m")
    right = hashlib.sha256(b'["1"]').hexdigest()
    bound = spark.createDataFrame([("a", 1, right), ("b", 2, right), ("c", 1, "x"), ("d", 1, right)], "g string, members long, digest string")
    assert {r["g"]: r["binding"] for r in lg.compare_bound(d, bound, ["g"]).collect()} == {"a": "ok", "b": "count", "c": "digest", "d": "missing"}


def test_fit_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(300, 2)) * [3, 0.5] + [1, -2]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(int)
    d = spark.createDataFrame([(float(a), float(c), int(t)) for (a, c), t in zip(x, y)], "a double, c double, y int")
    one, many = (st.fit_logistic(d.repartition(k), ["a", "c"], "y") for k in (1, 13))
    assert one["coefficients"] == pytest.approx(many["coefficients"], abs=1e-9) and max(map(abs, one["gradient"])) < 1e-10
    z = np.c_[np.ones(300), (x - x.mean(0)) / x.std(0)]
    p = 1 / (1 + np.exp(-z @ np.array(one["coefficients"])))
    h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0, 1, 1])
    assert one["errors"] == pytest.approx(list(np.sqrt(np.diag(np.linalg.inv(h)))), rel=1e-6)


def test_narrow_distribution(spark):
    """200,000 distinct values between 1.00 and 1.01 and one far out: ranges follow the data."""
    d = spark.range(200_000).select(F.lit("g").alias("g"), (1 + F.col("id") / 2e7).alias("v")).unionByName(spark.createDataFrame([("g", 1e9), ("h", None), ("h", 2.0), ("h", float("nan"))], "g string, v double"))
    x = np.append(1 + np.arange(200_000) / 2e7, 1e9)
    got = {r["g"]: r for r in st.distribution(d, ["g"], "v").collect()}
    for name, q in st.QUARTILES.items():
        assert got["g"][name] == pytest.approx(float(np.quantile(x, q)), abs=1e-12)
        assert got["h"][name] == 2.0
    assert got["h"]["missing"] == 2 and got["g"]["n"] == 200_001
    sizes = [r["count"] for r in d.filter("v < 2").repartitionByRange(100, "g", "v").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 200_000 * 0.03
