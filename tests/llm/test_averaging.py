import numpy as np
import pytest

from marginalia.llm import gru_lm


@pytest.mark.parametrize(("parts", "fan_in"), [(3, 64), (90, 8), (90, 64)])
def test_tree_of_means(spark, monkeypatch, parts, fan_in):
    """Weighted means of many tasks' pieces, level by level; no group holds more than ``fan_in`` of them."""
    monkeypatch.setattr(gru_lm, "FAN_IN", fan_in)
    rng = np.random.default_rng(1)
    values, weights = rng.normal(size=(parts, 2, 5)), rng.integers(1, 1000, parts).astype(float)
    rows = [(piece, float(weights[i]), values[i, piece].tobytes()) for i in range(parts) for piece in range(2)]
    local = spark.createDataFrame(rows, "piece int, weight double, values binary").repartition(parts)
    got = sorted(gru_lm.averaged(local, parts).collect())
    for r in got:
        assert r["weight"] == weights.sum()
        assert np.allclose(np.frombuffer(r["values"]), np.average(values[:, r["piece"]], axis=0, weights=weights))
    assert [r["piece"] for r in got] == [0, 1]
