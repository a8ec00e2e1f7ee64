"""The one-class detector learns from every row."""

import numpy as np

from ketspark.operators import models


def test_a_small_mode_and_the_share_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0.4, 0.25, (3000, 2)), rng.normal(2.4, 0.25, (1000, 2))))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double").repartition(3)
    model = models.KernelAnomalyDetector(["a", "b"], 0.1).fit(df)
    got = [r.prediction for r in model.transform(df).orderBy("i").collect()]
    assert abs(np.mean(np.array(got) < 0) - 0.1) < 0.002  # nu of all rows, not of a sample
    # optimum: w is as short as the dual solution over all rows of a table small enough for it
    few = x[::20]
    n, k = len(few), models.gram(few, few)
    a = np.full(n, 1 / n)
    a = models.solve_box(k, np.zeros(n), 1 / (0.1 * n), np.ones(n), a)
    small = spark.createDataFrame([tuple(map(float, v)) for v in few], "a double, b double")
    w = models.KernelAnomalyDetector(["a", "b"], 0.1).fit(small).params["w"]
    assert np.isclose(w @ w, a @ k @ a, rtol=1e-3)
