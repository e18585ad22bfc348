"""Seasonal forecasts, one model per series, fitted in parallel by exact likelihood.

The model differences a monthly series once and once over twelve months and describes
the result by one ordinary and one seasonal term of each kind (autoregressive a, A and
moving average m, M), without a constant:

    (1 - aB)(1 - AB^12) w[t] = (1 + mB)(1 + MB^12) e[t],  w = (1 - B)(1 - B^12) y

Spark reduces the lines to month totals and hands each task whole series, which are
bounded by the calendar; only this fit runs in Python. The thirteen levels that differencing
takes up have a diffuse start, under which the likelihood of a series is that of its
differences. A Kalman filter gives it, with the stationary law as the differences' start, for
many parameter rows at once. Coefficients stay within (-1, 1): the ordinary and the seasonal
autoregressive terms are stationary, and moving averages beyond the unit circle have the
likelihood of one within.

A fit's status is ``ok``, ``weak`` where the likelihood doesn't settle the coefficients (too few
months, a coefficient at its limit, no positive definite information), ``unconverged`` where
the search ran out of steps, or ``too_short`` where nothing could be fitted. Predictions are given for
the first three.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators.monthly import SEASON, SHORTEST, TEST_MONTHS

Z95 = 1.959963984540054
PARAMETERS = ("ar", "seasonal_ar", "ma", "seasonal_ma")
_STARTS = np.array(((0.0, 0.0, -0.3, -0.3), (0.3, 0.2, -0.6, -0.6), (-0.3, -0.2, 0.2, -0.2)))
_ORDER = SEASON + 2
#: Coefficients are held within this limit, and count as being at it within the margin.
LIMIT, MARGIN = 0.9999, 0.001
#: Fewer differenced months than these leave four coefficients and a variance unsettled.
FEWEST = 10
STEPS = 100


class Fit(NamedTuple):
    """Coefficients in the order of PARAMETERS, error variance, log-likelihood, standard errors (not a
    number where unknown) and status."""

    params: np.ndarray
    variance: float
    log_likelihood: float
    errors: np.ndarray
    status: str


def _polynomials(params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressive weights of lags 1 to 14 and moving-average weights of lags 0 to 13, a row each."""
    a, big_a, m, big_m = params.T
    past, shocks = np.zeros((2, len(params), _ORDER))
    past[:, 0], past[:, SEASON - 1], past[:, SEASON] = a, big_a, -a * big_a
    shocks[:, 0], shocks[:, 1], shocks[:, SEASON], shocks[:, SEASON + 1] = 1.0, m, big_m, m * big_m
    return past, shocks


def _responses(past: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """The effect of a shock 0 to 13 months later."""
    out = shocks.copy()
    for j in range(1, _ORDER):
        out[:, j] += np.einsum("bi,bi->b", past[:, :j], out[:, j - 1 :: -1][:, :j])
    return out


def autocovariances(params: np.ndarray, lags: int = _ORDER) -> np.ndarray:
    """Autocovariances of the differences at lags 0, 1, ... for an error variance of one."""
    past, shocks = _polynomials(params)
    response, n = _responses(past, shocks), _ORDER
    system, right = np.tile(np.eye(n), (len(params), 1, 1)), np.zeros((len(params), n))
    for h in range(n):
        for lag in (1, SEASON, SEASON + 1):
            system[:, h, abs(h - lag)] -= past[:, lag - 1]
        right[:, h] = np.einsum("bj,bj->b", shocks[:, h:], response[:, : n - h])
    out = np.zeros((len(params), max(lags, n)))
    out[:, :n] = np.linalg.solve(system, right[:, :, None])[:, :, 0]
    for h in range(n, lags):
        for lag in (1, SEASON, SEASON + 1):
            out[:, h] += past[:, lag - 1] * out[:, h - lag]
    return out[:, :lags]


def filtered(params: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of the Kalman filter and their variances (in units of the error variance): a row
    per month, a column per parameter row.

    The state's covariance changes from month to month by a matrix of rank one, whose one factor is carried
    along instead of the matrix (Chandrasekhar recursions), so a month takes time linear in the state."""
    past, shocks = _polynomials(params)
    covariance, response = autocovariances(params), _responses(past, shocks)

    def onward(state: np.ndarray) -> np.ndarray:
        moved = past * state[:, :1]
        moved[:, :-1] += state[:, 1:]
        return moved

    first = covariance.copy()  # of each element of the state with the observed one
    for i in range(1, _ORDER):
        first[:, i] = np.einsum("bj,bj->b", past[:, i:], covariance[:, 1 : _ORDER - i + 1])
        first[:, i] += np.einsum("bj,bj->b", shocks[:, i:], response[:, : _ORDER - i])
    spread, gain, state = covariance[:, 0].copy(), onward(first), np.zeros_like(past)
    factor, weight = gain.copy(), -1.0 / spread
    errors, spreads = np.zeros((2, len(w), len(params)))
    for t, value in enumerate(w):
        error = value - state[:, 0]
        errors[t], spreads[t] = error, spread
        state = onward(state) + gain * (error / spread)[:, None]
        seen, moved = factor[:, 0], onward(factor)
        pull = weight * seen
        gain = gain + moved * pull[:, None]
        weight, spread = weight + pull * pull / spread, spread + pull * seen
        factor = moved - gain * (seen / spread)[:, None]
    return errors, spreads


def log_likelihood(params: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood of the differences for each parameter row at its best error variance, and that
    variance."""
    errors, spreads = filtered(np.atleast_2d(params), w)
    variance = np.mean(errors**2 / spreads, axis=0)
    with np.errstate(divide="ignore"):
        value = -0.5 * (len(w) * (np.log(2 * np.pi * variance) + 1) + np.log(spreads).sum(axis=0))
    return value, variance


def _search(w: np.ndarray) -> tuple[np.ndarray, bool]:
    """The coefficients of the highest likelihood and whether the search for them ended by itself.

    The likelihood is highest where the scaled errors below have the least sum of squares; damped least
    squares looks for it from a few fixed starts in step, on a scale that has no limits."""
    starts, nudge = len(_STARTS), 1e-6
    probes = np.vstack([np.zeros(4), nudge * np.eye(4)])

    def scaled(points: np.ndarray) -> np.ndarray:
        tried = LIMIT * np.tanh((points[:, None, :] + probes).reshape(-1, 4))
        errors, spreads = filtered(tried, w)
        scale = np.exp(np.mean(np.log(spreads), axis=0) / 2)
        return (errors / np.sqrt(spreads) * scale).T.reshape(starts, 5, len(w))

    here, damping = np.arctanh(_STARTS), np.full(starts, 1e-2)
    with np.errstate(all="ignore"):
        errors = scaled(here)
        cost = np.einsum("st,st->s", errors[:, 0], errors[:, 0])
        settled = np.zeros(starts, bool)
        for _ in range(STEPS):
            slope = (errors[:, 1:] - errors[:, :1]) / nudge
            normal = np.einsum("sit,sjt->sij", slope, slope)
            pull = np.einsum("sit,st->si", slope, errors[:, 0])
            ridge = np.einsum("sii->si", normal) * damping[:, None] + 1e-12
            move = np.linalg.solve(normal + ridge[:, :, None] * np.eye(4), -pull[:, :, None])[:, :, 0]
            there = here + np.clip(move, -1.0, 1.0)
            tried = scaled(there)
            new_cost = np.einsum("st,st->s", tried[:, 0], tried[:, 0])
            better = np.isfinite(new_cost) & np.isfinite(tried).all(axis=(1, 2)) & (new_cost < cost)
            gain = np.where(better, cost - new_cost, 0.0)
            settled |= (gain <= 1e-7 * cost) & (better | (damping > 1e6))
            here = np.where(better[:, None], there, here)
            errors = np.where(better[:, None, None], tried, errors)
            cost = np.where(better, new_cost, cost)
            damping = np.where(better, damping / 4, damping * 5)
            best = int(np.argmin(cost))
            if settled.all():
                break
    return LIMIT * np.tanh(here[best]), bool(settled[best])


def _standard_errors(params: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Square roots of the diagonal of the inverse observed information; not a number where it has none."""
    unknown = np.full(4, np.nan)
    step = np.minimum(1e-3, (1 - np.abs(params)) / 4)
    if np.any(step < MARGIN / 8):
        return unknown
    unit, points = np.diag(step), [params]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    for i, j in pairs:
        points += [params + si * unit[i] + sj * unit[j] for si in (1, -1) for sj in (1, -1)]
    value = log_likelihood(np.array(points), w)[0]
    information = np.zeros((4, 4))
    for k, (i, j) in enumerate(pairs):
        both, up, down, neither = value[1 + 4 * k : 5 + 4 * k]
        information[i, j] = information[j, i] = -(both - up - down + neither) / (4 * step[i] * step[j])
    if not np.all(np.isfinite(information)) or np.linalg.eigvalsh(information)[0] <= 0:
        return unknown
    return np.sqrt(np.diag(np.linalg.inv(information)))


def _differenced(y: np.ndarray) -> np.ndarray:
    step = y[1:] - y[:-1]
    return step[SEASON:] - step[:-SEASON]


def fit(values: np.ndarray, params: Sequence[float] | None = None) -> Fit:
    """The model of a series of more than thirteen values, or what given coefficients make of it."""
    y = np.asarray(values, dtype=float)
    scale = float(np.max(np.abs(y))) or 1.0
    w = _differenced(y / scale)
    if np.max(np.abs(w)) < 1e-12:  # the rounding errors of a series without any
        w = np.zeros(len(w))
    found, ended = (np.array(params, dtype=float), True) if params is not None else _search(w)
    value, variance = (x[0] for x in log_likelihood(found, w))
    errors = _standard_errors(found, w) if params is None and variance > 0 else np.full(4, np.nan)
    status = "given" if params is not None else "ok"
    if params is None and not ended:
        status = "unconverged"
    elif params is None and (len(w) < FEWEST or np.isnan(errors).any()):
        status = "weak"
    return Fit(found, variance * scale**2, value - len(w) * np.log(scale), errors, status)


def predict(values: np.ndarray, horizon: int, model: Fit | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forecast and its standard error for each of the next ``horizon`` months.

    Needs more than thirteen values, the number the differencing takes up. The months to come have the
    law that the known ones leave them, from the joint one of both."""
    y = np.asarray(values, dtype=float)
    model = model or fit(y)
    w, n = _differenced(y), len(y) - SEASON - 1
    lags = autocovariances(model.params[None], n + horizon)[0]
    place = np.arange(n + horizon)
    root = np.linalg.cholesky(lags[np.abs(place[:, None] - place)])
    ahead = root[n:, :n] @ np.linalg.solve(root[:n, :n], w)
    level = list(y)
    for step in ahead:
        level.append(step + level[-1] + level[-SEASON] - level[-SEASON - 1])
    # A difference's error is carried into the levels once more with every year that passes.
    carried = np.tril(1.0 + (place[:horizon, None] - place[:horizon]) // SEASON)
    spread = carried @ root[n:, n:]
    return np.array(level[len(y) :]), np.sqrt(model.variance * np.sum(spread**2, axis=1))


def _spread(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series spread over all shuffle tasks by key.

    Fits are heavy and their input is tiny, so the size-based merging of shuffle
    partitions would line thousands of fits up in a few tasks; a partition count that is
    asked for is left alone.
    """
    if not keys:
        return series
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.repartition(tasks, *keys)


def _month_ends(last: pd.Timestamp, horizon: int) -> list:
    return [day.date() for day in pd.date_range(last, periods=horizon + 1, freq="ME")[1:]]


PHASES = ("held_out", "future")


def seasonal_forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    phases: Sequence[str] = PHASES,
    horizon: int = TEST_MONTHS,
    held_out: int = TEST_MONTHS,
    params: Sequence[float] | None = None,
) -> DataFrame:
    """Forecasts each series' held-out last months, the months to come, or both.

    Rows carry the ``phase``, the month end, the prediction and its 95 % interval, and for
    held-out months the actual sales. A series too short to model yields one row per phase
    with a status and nulls. With ``params`` given, nothing is fitted and the status is ``given``.
    """
    numbers = ("actual_sales", "predicted_sales", "lower_ci", "upper_ci")
    schema = T.StructType(
        [
            *[series.schema[name] for name in keys],
            T.StructField("phase", T.StringType()),
            T.StructField("month", T.DateType()),
            *[T.StructField(name, T.DoubleType()) for name in numbers],
            T.StructField("status", T.StringType()),
        ]
    )
    names, order = list(keys), [field.name for field in schema.fields]

    def phase_rows(phase: str, values: np.ndarray, last: pd.Timestamp) -> pd.DataFrame:
        ahead = held_out if phase == "held_out" else horizon
        known = values[:-held_out] if phase == "held_out" else values
        if len(values) < SHORTEST or len(known) <= SEASON + 1:
            empty = pd.DataFrame({name: [np.nan] for name in numbers})
            return empty.assign(phase=phase, month=None, status="too_short")
        start = last - pd.offsets.MonthEnd(len(values) - len(known))
        model = fit(known, params)
        center, error = predict(known, ahead, model)
        return pd.DataFrame(
            {
                "phase": phase,
                "month": _month_ends(start, ahead),
                "actual_sales": values[-held_out:] if phase == "held_out" else np.nan,
                "predicted_sales": center,
                "lower_ci": center - Z95 * error,
                "upper_ci": center + Z95 * error,
                "status": model.status,
            }
        )

    def rows_of(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("month")
        values = ordered["sales"].to_numpy(dtype=float)
        last = pd.Timestamp(ordered["month"].iloc[-1])
        rows = pd.concat([phase_rows(phase, values, last) for phase in phases])
        return rows.assign(**{name: ordered[name].iloc[0] for name in names})[order]

    rows = _spread(series, names).groupBy(*keys).applyInPandas(rows_of, schema)
    return rows.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in numbers})


def seasonal_fits(
    series: DataFrame, keys: Sequence[str] = (), params: Sequence[float] | None = None
) -> DataFrame:
    """The model of each whole series, one row per coefficient: estimate, standard error and 95 %
    interval, with the series' log-likelihood, error variance, differenced months and status. A
    series too short to model has one row of nulls. ``params`` are coefficients to evaluate instead."""
    numbers = ("estimate", "std_error", "lower_ci", "upper_ci", "log_likelihood", "variance")
    schema = T.StructType(
        [
            *[series.schema[name] for name in keys],
            T.StructField("parameter", T.StringType()),
            *[T.StructField(name, T.DoubleType()) for name in numbers],
            T.StructField("differenced_months", T.LongType()),
            T.StructField("status", T.StringType()),
        ]
    )
    names, order = list(keys), [field.name for field in schema.fields]

    def rows_of(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("month")["sales"].to_numpy(dtype=float)
        months = max(0, len(values) - SEASON - 1)
        if len(values) < SHORTEST:
            rows = pd.DataFrame({name: [np.nan] for name in numbers}).assign(
                parameter=None, differenced_months=months, status="too_short"
            )
        else:
            found = fit(values, params)
            rows = pd.DataFrame(
                {
                    "parameter": PARAMETERS,
                    "estimate": found.params,
                    "std_error": found.errors,
                    "lower_ci": found.params - Z95 * found.errors,
                    "upper_ci": found.params + Z95 * found.errors,
                    "log_likelihood": found.log_likelihood if np.isfinite(found.log_likelihood) else np.nan,
                    "variance": found.variance,
                    "differenced_months": months,
                    "status": found.status,
                }
            )
        return rows.assign(**{name: group[name].iloc[0] for name in names})[order]

    rows = _spread(series, names).groupBy(*keys).applyInPandas(rows_of, schema)
    return rows.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in numbers})
