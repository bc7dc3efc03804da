"""Hand-made cases and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.functions import names
from lodeweave.operators import evaluate, sampling, similarity, transport


def test_names(spark):
    df = spark.createDataFrame([("http://x/ontology/releaseDate",), ("http://x/ontology/aBcDE_fooBar",), ("noslash",), ("http://x/bornIn_(inv)",)], "u string")
    got = [r[0] for r in df.select(names.predicate_name(F.col("u"))).collect()]
    assert got == ["release date", "a bc de foo bar", "noslash", "born in"]


def test_answers(spark):
    df = spark.createDataFrame([("The correct answer : (B) x",), ("answer should be (c)",), ("nope",), ("Answer is= (D)",), (None,)], "t string")
    assert [r[0] for r in df.select(names.parse_answer(F.col("t"))).collect()] == ["b", "c", None, "d", None]


def test_cutoffs(spark):
    df = spark.createDataFrame([(1, 10 + i, s, i + 1) for i, s in enumerate([0.9, 0.85, 0.4, 0.39])], "q long, c long, score double, rk int")
    assert evaluate.cutoff_point(df).first()["cutoff"] == 2
    assert evaluate.cutoff_moving(df).first()["cutoff"] == 2


def test_gold_ties_count_against(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (1, 3, 0.5), (1, 4, 0.1)], "q long, c long, new double")
    assert evaluate.rerank_rank(s, spark.createDataFrame([(1, 1)], "q long, gold long")).first()["rk"] == 3


def test_sinkhorn_marginals(spark):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(rng.random((6, 6)))], "q long, c long, cost double")
    p = transport.sinkhorn(cells, 200, 0.1, False).toPandas()
    assert np.allclose(p.groupby("q").p.sum(), 1 / 6) and np.allclose(p.groupby("c").p.sum(), 1 / 6, atol=1e-6)


@pytest.mark.parametrize("metric", similarity.METRICS)
def test_blocks_do_not_change_top_k(spark, metric):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.random(4)]) for i in range(40)], "id long, v array<double>")
    a = similarity.top_k(df, df, 5, metric).orderBy("q", "rk").collect()
    assert a == similarity.top_k(df, df, 5, metric, block_rows=7).orderBy("q", "rk").collect()


def test_position_order(spark):
    df = spark.createDataFrame([(1, c, c, c == 5) for c in range(1, 6)], "q long, c long, rk int, is_gold boolean")
    got = sampling.reorder(df, "position", position=2).orderBy("ord").collect()
    assert [r["c"] for r in got] == [1, 5, 2, 3, 4]
    with pytest.raises(ValueError):
        sampling.reorder(df, "other")


def test_driver_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
