import numpy as np
import pytest

import riskloom as rl
from riskloom.functions.special import chi2_tail, normal_quantile, normal_tail, t_tail
from riskloom.values import soft


def test_losses_match_numeric_gradients():
    rng = np.random.default_rng(0)
    y, eta, w = rng.integers(0, 2, 20).astype(float), rng.normal(size=20), rng.uniform(0.5, 2, 20)
    for loss in (rl.squared_error(), rl.logistic()):
        grad, h = loss.gradient(y, eta, w), 1e-6
        for i in range(3):
            up, down = eta.copy(), eta.copy()
            up[i] += h
            down[i] -= h
            assert abs((loss.value(y, up, w) - loss.value(y, down, w)) / (2 * h) - grad[i]) < 1e-7
        assert (loss.hessian(y, eta, w) >= 0).all()
    assert np.isfinite(rl.logistic().value(np.array([1.0, 0.0]), np.array([800.0, 900.0])))


def test_weights_are_checked():
    for bad in ([1.0], [-1.0, 1.0], [0.0, 0.0], [np.nan, 1.0]):
        with pytest.raises(ValueError):
            rl.squared_error().value(np.zeros(2), np.zeros(2), np.array(bad))


def test_penalties():
    p = rl.l1(0.5) + rl.l2(2.0)
    assert p.value(np.array([1.0, -2.0])) == pytest.approx(0.5 * 3 + 5)
    assert p.kind == "mixed" and rl.l1(1).kind == "l1" and rl.NoPenalty.kind == "none"
    b = np.array([3.0, -0.1])
    assert np.allclose(p.prox(b, 0.5), soft(b, 0.25) / 2)
    assert np.allclose((rl.NoPenalty + rl.l2(2)).prox(b, 0.5), b / 2)
    for bad in (-1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            rl.l1(bad)
    with pytest.raises(TypeError):
        rl.l1(1) + "x"


def test_distributions_against_known_values():
    assert normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert t_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert t_tail(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-10)
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert chi2_tail(0, 3) == 1.0


def test_specs_are_checked():
    spec = rl.linear("y", ["a", rl.hinge("b", 1.0) + "c"], loss=rl.logistic(), penalty=rl.l2(1))
    assert [type(t).__name__ for t in spec.features] == ["Raw", "Hinge", "Raw"] and spec.reads() == ["a", "b", "c"]
    assert hash(spec) == hash(rl.linear("y", ["a", rl.hinge("b", 1.0) + "c"], loss=rl.logistic(), penalty=rl.l2(1)))
    for bad in (lambda: rl.linear("y", []), lambda: rl.linear("", "a"), lambda: rl.segmented("a", spec), lambda: rl.step("x", [2, 1]), lambda: rl.manual([1, 1]), lambda: rl.ns("x", 1), lambda: rl.bs("x", 3), lambda: rl.hinge("x", 0, "up"), lambda: rl.interact("x"), lambda: rl.log_grid(2, 1, 5)):
        with pytest.raises(ValueError):
            bad()
