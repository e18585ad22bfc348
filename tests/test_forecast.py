from __future__ import annotations

from datetime import date

import numpy as np
import pytest

from tillwise.operators.monthly import (
    accuracy,
    describe_series,
    hold_out,
    monthly_sales,
    require_sales,
    unusable_count,
)
from tillwise.operators.seasonal_model import (
    PARAMETERS,
    autocovariances,
    fit,
    log_likelihood,
    predict,
    seasonal_fits,
    seasonal_forecast,
)
from tillwise.plans import outlook


def month(index: int) -> date:
    return date(2018 + index // 12, index % 12 + 1, 15)


def lines_of(rows, values, key="k", extra=()):
    data = [(key, month(i), float(v)) for i, v in enumerate(values)]
    return rows(data + list(extra), "key string, order_date date, sales double")


def test_gaps_become_zero_months(rows):
    frame = rows(
        [("a", date(2019, 11, 30), 5.0), ("a", date(2020, 2, 1), 7.0), ("a", date(2020, 2, 29), 1.5),
         ("b", date(2020, 1, 1), 2.0)],
        "key string, order_date date, sales double",
    )
    got = {(r["key"], r["month"]): r["sales"] for r in monthly_sales(frame, ["key"]).collect()}
    assert got == {
        ("a", date(2019, 11, 30)): 5.0,
        ("a", date(2019, 12, 31)): 0.0,
        ("a", date(2020, 1, 31)): 0.0,
        ("a", date(2020, 2, 29)): 8.5,
        ("b", date(2020, 1, 31)): 2.0,
    }
    assert monthly_sales(frame).count() == 4


def test_unusable_lines_are_counted_and_left_out(rows):
    frame = rows(
        [("2020-01-01", "3"), ("nope", "4"), ("2020-01-05", "x"), (None, None), ("1/9/2020", "2.5")],
        "order_date string, sales string",
    )
    assert tuple(unusable_count(frame).first()) == (3, 5)
    assert monthly_sales(frame).first()["sales"] == 5.5
    with pytest.raises(ValueError, match="no line has both"):
        require_sales(frame.where("sales = 'x'"))
    with pytest.raises(ValueError, match="columns not found: sales"):
        monthly_sales(frame.drop("sales"))


def test_length_gate(rows):
    for length, status in ((1, "too_short"), (18, "too_short"), (19, "ok")):
        series = monthly_sales(lines_of(rows, range(1, length + 1)))
        assert describe_series(series).first()["status"] == status


def test_hold_out_takes_the_last_six(rows):
    parts = hold_out(monthly_sales(lines_of(rows, range(1, 21)))).orderBy("month").collect()
    assert [r["part"] for r in parts] == ["train"] * 14 + ["test"] * 6


def test_accuracy_skips_zero_actuals(rows):
    frame = rows(
        [("a", 10.0, 8.0), ("a", 0.0, 1.0), ("b", 0.0, 2.0), ("c", 5.0, 5.0)],
        "key string, actual double, predicted double",
    )
    got = {r["key"]: (r["mae"], r["rmse"], r["mape"]) for r in accuracy(frame, ["key"]).collect()}
    assert got["a"] == (1.5, pytest.approx(2.5**0.5), pytest.approx(20.0))
    assert got["b"] == (2.0, 2.0, None)
    assert got["c"] == (0.0, 0.0, 0.0)


def simulated(n, params, seed=5, spread=1.0):
    a, big_a, m, big_m = params
    noise = np.random.default_rng(seed).normal(0, spread, n + 300)
    w = np.zeros(n + 300)
    for t in range(13, len(w)):
        w[t] = (
            a * w[t - 1] + big_a * w[t - 12] - a * big_a * w[t - 13]
            + noise[t] + m * noise[t - 1] + big_m * noise[t - 12] + m * big_m * noise[t - 13]
        )
    return w[300:]


def integrated(w):
    y = np.zeros(len(w) + 13)
    for t in range(13, len(y)):
        y[t] = w[t - 13] + y[t - 1] + y[t - 12] - y[t - 13]
    return y


def shock_sums(params, lags, terms=6000):
    """Autocovariances by summing the effects of single shocks."""
    a, big_a, m, big_m = params
    moving = np.zeros(terms)
    moving[[0, 1, 12, 13]] = 1, m, big_m, m * big_m
    effect = np.zeros(terms + 13)
    for t in range(terms):
        effect[t + 13] = moving[t] + a * effect[t + 12] + big_a * effect[t + 1] - a * big_a * effect[t]
    effect = effect[13:]
    return np.array([effect[: terms - h] @ effect[h:] for h in range(lags)])


def density(covariance, values):
    """Log of the Gaussian density of values."""
    solved = values @ np.linalg.solve(covariance, values)
    return -0.5 * (len(values) * np.log(2 * np.pi) + np.linalg.slogdet(covariance)[1] + solved)


def toeplitz(lags):
    place = np.arange(len(lags))
    return lags[np.abs(place[:, None] - place)]


PARAMS = [(0.3, 0.2, -0.4, -0.3), (0.9, -0.7, 0.5, 0.95), (-0.5, 0.8, 0.99, -0.999), (0.0, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("params", PARAMS)
def test_likelihood_is_that_of_the_dense_law(params):
    for length in (1, 13, 14, 50):
        w = np.random.default_rng(length).normal(size=length)
        lags = shock_sums(params, length)
        assert autocovariances(np.array([params]), length)[0] == pytest.approx(lags, rel=1e-6, abs=1e-9)
        value, variance = log_likelihood(np.array(params), w)
        assert value[0] == pytest.approx(density(variance[0] * toeplitz(lags), w), rel=1e-7)


def test_likelihood_of_rows_at_once_is_that_of_each():
    w = np.random.default_rng(2).normal(size=40)
    together = log_likelihood(np.array(PARAMS), w)[0]
    assert together == pytest.approx([log_likelihood(np.array(p), w)[0][0] for p in PARAMS])


def test_differences_have_the_likelihood_of_levels_with_a_diffuse_start():
    params, wide, n = PARAMS[0], 1e5, 40
    y = integrated(simulated(n - 13, params, seed=8))
    value, variance = log_likelihood(np.array(params), y[13:] - y[12:-1] - y[1:-12] + y[:-13])
    # levels as a linear map of thirteen wide first levels and the differences
    covariance = np.zeros((n, n))
    covariance[:13, :13] = wide * np.eye(13)
    covariance[13:, 13:] = variance[0] * toeplitz(shock_sums(params, n - 13))
    onward = np.eye(n)
    for t in range(13, n):
        onward[t] += onward[t - 1] + onward[t - 12] - onward[t - 13]
    start = 0.5 * 13 * np.log(2 * np.pi * wide)
    assert density(onward @ covariance @ onward.T, y) + start == pytest.approx(value[0], abs=1e-2)


def test_fit_recovers_known_parameters():
    truth = (0.6, 0.4, 0.5, 0.5)
    found = fit(integrated(simulated(1500, truth)))
    assert found.params == pytest.approx(truth, abs=0.1)
    assert found.variance == pytest.approx(1.0, abs=0.1) and found.status == "ok"
    assert np.all(np.abs(found.params - truth) < 4 * found.errors) and np.all(found.errors < 0.06)


def test_no_nearby_parameters_are_likelier():
    y = integrated(simulated(90, (0.3, 0.1, -0.5, -0.5), seed=3))
    found, w = fit(y), y[13:] - y[12:-1] - y[1:-12] + y[:-13]
    near = found.params + np.random.default_rng(4).normal(0, 0.05, (200, 4)).clip(-0.2, 0.2)
    assert log_likelihood(near.clip(-0.99, 0.99), w)[0].max() <= found.log_likelihood + 1e-6


def test_standard_errors_are_the_spread_of_estimates():
    truth = (0.6, 0.4, 0.5, 0.5)
    fits = [fit(integrated(simulated(250, truth, seed))) for seed in range(30)]
    spread = np.std([f.params for f in fits], axis=0)
    said = np.nanmedian([f.errors for f in fits], axis=0)
    assert np.all(said / spread > 0.6) and np.all(said / spread < 1.7)


def test_interval_is_that_of_the_dense_law():
    params, n, ahead = PARAMS[0], 60, 15
    y = integrated(simulated(n - 13, params, seed=9))
    model = fit(y, params)
    center, error = predict(y, ahead, model)
    w = y[13:] - y[12:-1] - y[1:-12] + y[:-13]
    joint = model.variance * toeplitz(shock_sums(params, len(w) + ahead))
    known, cross, new = joint[: len(w), : len(w)], joint[len(w) :, : len(w)], joint[len(w) :, len(w) :]
    left = new - cross @ np.linalg.solve(known, cross.T)
    onward = np.eye(ahead)
    for t in range(1, ahead):
        onward[t] += onward[t - 1]
        if t >= 12:
            onward[t] += onward[t - 12]
        if t >= 13:
            onward[t] -= onward[t - 13]
    assert error == pytest.approx(np.sqrt(np.diag(onward @ left @ onward.T)), rel=1e-6)
    first = cross[0] @ np.linalg.solve(known, w) + y[-1] + y[-12] - y[-13]
    assert center[0] == pytest.approx(first) and model.status == "given"


def test_status_tells_weak_and_unfinished_fits(monkeypatch):
    y = integrated(simulated(60, (0.3, 0.1, -0.5, -0.5)))
    assert fit(y[:20]).status == "weak"
    line = fit(np.arange(30.0))
    assert line.status == "weak" and line.variance == 0 and np.isnan(line.errors).all()
    # white noise differenced over has a moving average at its limit
    assert fit(np.random.default_rng(1).normal(size=400)).status == "weak"
    monkeypatch.setattr("tillwise.operators.seasonal_model.STEPS", 2)
    assert fit(y).status == "unconverged"


def test_fits_of_series(rows):
    y = 100 + integrated(simulated(107, (0.3, 0.1, -0.5, -0.5)))
    frame = lines_of(rows, y, extra=[("short", month(3), 1.0)])
    got = seasonal_fits(monthly_sales(frame, ["key"]), ["key"]).collect()
    own = {r["parameter"]: r for r in got if r["key"] == "k"}
    whole = fit(y)
    assert set(own) == set(PARAMETERS)
    for i, name in enumerate(PARAMETERS):
        assert own[name]["estimate"] == pytest.approx(whole.params[i], abs=1e-3)
        assert own[name]["upper_ci"] - own[name]["estimate"] == pytest.approx(1.96 * own[name]["std_error"], rel=1e-3)
    assert own["ar"]["log_likelihood"] == pytest.approx(whole.log_likelihood, abs=1e-3)
    assert own["ar"]["differenced_months"] == 107 and own["ar"]["status"] == whole.status
    short = [r for r in got if r["key"] == "short"]
    assert [(r["parameter"], r["estimate"], r["status"]) for r in short] == [(None, None, "too_short")]


def test_noiseless_trend_and_season_is_continued_exactly():
    t = np.arange(66)
    y = 500 + 3 * t + 40 * np.sin(2 * np.pi * t / 12)
    center, error = predict(y[:60], 6)
    assert center == pytest.approx(y[60:])
    assert np.all(error < 1e-6)


def test_interval_widens_and_scales():
    y = 1000 + integrated(simulated(80, (0.2, 0.1, -0.5, -0.4)))
    center, error = predict(y, 6)
    assert np.all(np.diff(error) > 0)
    more, wider = predict(1000 * y, 6)
    assert more == pytest.approx(1000 * center, rel=1e-6)
    assert wider == pytest.approx(1000 * error, rel=1e-6)


def test_interval_covers_the_truth_about_as_often_as_it_says():
    inside = total = 0
    for seed in range(60):
        y = 100 + integrated(simulated(186, (0.3, 0.1, -0.5, -0.5), seed))
        center, error = predict(y[:-6], 6)
        inside += int(np.sum(np.abs(y[-6:] - center) <= 1.96 * error))
        total += 6
    assert 0.9 < inside / total <= 0.99


def test_forecast_rows(rows):
    t = np.arange(40)
    frame = lines_of(
        rows, 500 + 3 * t, extra=[("short", month(3), 1.0), ("edge", month(0), 1.0), ("edge", month(18), 2.0)]
    )
    got = seasonal_forecast(monthly_sales(frame, ["key"]), ["key"]).collect()
    ok = [r for r in got if r["key"] == "k"]
    held = sorted((r for r in ok if r["phase"] == "held_out"), key=lambda r: r["month"])
    future = sorted((r for r in ok if r["phase"] == "future"), key=lambda r: r["month"])
    assert [r["actual_sales"] for r in held] == [500.0 + 3 * i for i in range(34, 40)]
    assert [r["predicted_sales"] for r in held] == pytest.approx([500 + 3 * i for i in range(34, 40)])
    assert [r["predicted_sales"] for r in future] == pytest.approx([500 + 3 * i for i in range(40, 46)])
    assert held[0]["month"] == date(2020, 11, 30)
    assert future[-1]["month"] == date(2021, 10, 31)
    assert all(r["lower_ci"] <= r["predicted_sales"] <= r["upper_ci"] for r in ok)
    short = [r for r in got if r["key"] == "short"]
    assert [(r["status"], r["predicted_sales"], r["month"]) for r in short] == [("too_short", None, None)] * 2
    # nineteen months are enough for the full fit but not once six are held out
    edge = {r["phase"]: r["status"] for r in got if r["key"] == "edge"}
    assert edge == {"held_out": "too_short", "future": "weak"}


def test_one_short_series_is_an_error(rows):
    with pytest.raises(Exception, match="at least 19 months"):
        outlook.sales_forecast(lines_of(rows, range(1, 19))).collect()


def test_no_usable_line_is_an_error(rows):
    frame = rows([("a", None, 1.0), ("a", date(2020, 1, 1), None)], "key string, order_date date, sales double")
    for plan in (outlook.sales_forecast, outlook.forecast_accuracy, outlook.series_description):
        with pytest.raises(ValueError, match="no line has both"):
            plan(frame, ["key"])


def test_chart_points(rows):
    frame = lines_of(rows, 100 + 5 * np.sin(np.arange(30)))
    counts = {r["series"]: r["count"] for r in outlook.forecast_chart(frame).groupBy("series").count().collect()}
    assert counts == {"history": 30, "held_out_actual": 6, "held_out_predicted": 6, "forecast": 6}


def test_null_key_is_a_series(rows):
    frame = lines_of(rows, range(20, 45), key=None)
    assert outlook.sales_forecast(frame, ["key"]).count() == 6
    assert outlook.forecast_accuracy(frame, ["key"]).first()["mae"] == pytest.approx(0, abs=1e-6)
