"""Properties of the small numeric helpers, and recovery of known truths."""

import math

import numpy as np
import pytest

from tidemark.functions import special
from tidemark.operators import benchmarks, factor_model, montecarlo, tails


def test_digamma_recurrence_and_known_value():
    x = np.array([0.1, 1.0, 2.5, 7.0, 40.0])
    assert np.allclose(special.digamma(x + 1), special.digamma(x) + 1 / x, atol=1e-10)
    assert special.digamma(1.0)[0] == pytest.approx(-0.5772156649, abs=1e-9)


def smoothed(y, w=1.0):
    t = len(y)
    rows = factor_model.loading_rows([1.0], [0], [False], 1)
    return factor_model.smooth(y, rows, np.array([[0.5]]), np.array([[1.0]]), np.array([0.5]), np.eye(5), np.full(t, w), np.full(t, 1.0))


def test_filter_predicts_before_the_first_update():
    means, covs, loglik = smoothed(np.array([[np.nan]]))
    assert covs[0, 0, 0] == pytest.approx(1.25) and means[0, 0] == 0 and loglik == 0


def test_smoother_is_symmetric_and_shrinks_variance():
    y = np.array([[1.0], [np.nan], [3.0], [4.0]])
    means, covs, _ = smoothed(y)
    assert np.allclose(covs, covs.transpose(0, 2, 1)) and (np.linalg.eigvalsh(covs) > -1e-9).all()
    assert (covs[:, 0, 0] < 1.4).all() and 0 < means[1, 0] < 4


def test_quarterly_rows_weigh_five_months():
    rows = factor_model.loading_rows([2.0, 3.0], [0, 1], [False, True], 2)
    assert rows[0].tolist() == [2] + [0] * 9
    assert rows[1].sum() == pytest.approx(3 * 3.0) and rows[1, 1] == pytest.approx(1.0) and rows[1, 5] == pytest.approx(3.0)


@pytest.mark.parametrize("student", [True, False])
def test_fit_recovers_factors(student):
    y, loading, f, _, _ = montecarlo.draw_panel(150, 5.0, 0.0, 3)
    block, quarterly = np.arange(12) % 3, np.arange(12) == 11
    found = factor_model.fit(y, block, quarterly, 3, student, 20)
    # no estimate can be nearer the factors than the smoother at the true parameters, which this draw bounds
    rows = factor_model.loading_rows(loading, block, quarterly, 3)
    noise, ones = np.full(12, 0.25), np.ones(150)
    truth, *_ = factor_model.smooth(y, rows, np.eye(3) * 0.7, np.eye(3) * 0.36, noise, np.eye(15), ones, ones)
    near = lambda means, b: abs(np.corrcoef(means[:, b], f[:, b])[0, 1])
    assert all(near(found["means"], b) > near(truth, b) - 0.03 for b in range(3))
    assert np.abs(np.linalg.eigvals(found["transition"])).max() < 1 and (found["noise"] > 0).all()
    assert not student or 2 < found["nu_eps"] < 1000


def test_normalising_leaves_the_fit():
    y, *_ = montecarlo.draw_panel(100, 5.0, 0.0, 4)
    block, quarterly = np.arange(12) % 3, np.arange(12) == 11
    found = factor_model.fit(y, block, quarterly, 3, False, 5)
    made = factor_model.normalised(found, block, [0, 1, 2], 3)
    assert np.allclose(made["factors"][:, block[:9]] * made["loading"][:9], found["means"][:, :3][:, block[:9]] * found["loading"][:9])
    assert (made["loading"][:3] >= 0).all()
    assert np.allclose(np.sort(np.linalg.eigvals(made["transition"])), np.sort(np.linalg.eigvals(found["transition"])))


def test_contamination_lifts_detection():
    y, _, _, _, bad = montecarlo.draw_panel(200, np.inf, 0.05, 5)
    found = factor_model.fit(y, np.arange(12) % 3, np.arange(12) == 11, 3, True, 15)
    least = np.argsort(found["w_eps"])[: bad.sum()]
    assert bad[least].mean() > 0.6 > 10 * bad.mean() * 0.5


def test_arma_follows_an_autoregression():
    rng = np.random.default_rng(0)
    x = np.zeros(400)
    for t in range(1, 400):
        x[t] = 1 + 0.8 * x[t - 1] + rng.standard_normal() * 0.1
    assert benchmarks.arma_forecast(x, 1, 0, 1) == pytest.approx(1 + 0.8 * x[-1], abs=0.1)
    with pytest.raises(ValueError):
        benchmarks.arma_forecast(x[:4], 2, 2, 1)


def test_quantile_fit_splits_the_sample():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(500), rng.standard_normal(500)])
    y = x @ [1.0, 2.0] + rng.standard_normal(500)
    for tau in (0.1, 0.5, 0.9):
        assert (y < x @ tails.quantile_fit(x, y, tau)).mean() == pytest.approx(tau, abs=0.02)
