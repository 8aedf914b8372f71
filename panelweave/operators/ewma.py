"""Exponentially weighted means as prefix sums over bounded chunks.

y[t] = a*x[t] + (1-a)*y[t-1] with y[s] = x[s] at the first valid position s
unrolls to a weighted sum with weights (1-a)^(t-k). Scaled by (1-a)^(-k) that
is a running sum, but over a long series the scale leaves the double range. So
positions are cut into chunks: a running sum inside each chunk plus the state
carried from the chunk before. What lies two chunks back weighs less than
(1-a)^chunk, far under double precision, which `_chunk_for` makes sure of.

Only built-in window sums are used: no Python rows, no sorted array per key.
Columns are written as SQL text, which keeps wide vectors cheap to plan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Ewma:
    """One smoothed column: SQL text of the input, weight of the newest value, first valid position, rows needed."""

    value: str
    alpha: float
    start: int = 0
    min_periods: int = 1


def _chunk_for(alphas) -> int:
    """Chunk length for which older chunks vanish and the scale stays finite."""
    rates = [-math.log1p(-a) for a in alphas]
    shortest, longest = 45.0 / min(rates), 600.0 / max(rates)
    if shortest > longest:
        raise ValueError("smooth these weights in separate calls")
    return int(min(longest, max(shortest, 256.0)))


def add_ewma(df: DataFrame, specs: Mapping[str, Ewma], key: str = "ticker", pos: str = "_pos") -> DataFrame:
    """Add smoothed columns. `pos` is an integer position per key from 0 up; a gap counts as zeros.

    Values before `start` are ignored; the value at `start` has full weight.
    Rows earlier than `start + min_periods - 1` get NULL.
    """
    alphas = sorted({s.alpha for s in specs.values()})
    size = _chunk_for(alphas)
    keep = {a: 1.0 - a for a in alphas}
    tag = {a: i for i, a in enumerate(alphas)}
    inside = f"OVER (PARTITION BY {key}, _chunk ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"OVER (PARTITION BY {key} ORDER BY _chunk RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    own = list(df.columns)
    scales = []
    for a in alphas:
        scales += [f"power({keep[a]!r}D, -CAST(pmod({pos}, {size}) AS DOUBLE)) AS _up{tag[a]}",
                   f"power({keep[a]!r}D, CAST(pmod({pos}, {size}) AS DOUBLE)) AS _dn{tag[a]}"]
    d = df.selectExpr("*", f"CAST(floor({pos} / {size}) AS INT) AS _chunk", *scales)

    def weighted(s: Ewma) -> str:
        w = f"CASE WHEN {pos} = {s.start} THEN 1D ELSE {s.alpha!r}D END"
        return f"CASE WHEN {pos} >= {s.start} THEN coalesce(CAST({s.value} AS DOUBLE), 0D) * {w} * _up{tag[s.alpha]} ELSE 0D END"

    names = {n: f"_x{i}" for i, n in enumerate(specs)}
    d = d.selectExpr("*", *[f"{weighted(s)} AS {names[n]}" for n, s in specs.items()])
    d = d.selectExpr("*", *[e for n in specs for e in (
        f"sum({names[n]}) {inside} AS {names[n]}_in", f"sum({names[n]}) {before} AS {names[n]}_pre")])
    final = [f"CASE WHEN {pos} >= {s.start + s.min_periods - 1} THEN ({names[n]}_in + coalesce({names[n]}_pre, 0D) * "
             f"{keep[s.alpha] ** size!r}D) * _dn{tag[s.alpha]} END AS {n}" for n, s in specs.items()]
    return d.selectExpr(*[f"`{c}`" for c in own if c not in specs], *final)


@dataclass(frozen=True)
class GapEwma:
    """One smoothed column over present values: SQL text of the input, weight of the newest value, present values needed."""

    value: str
    alpha: float
    min_periods: int = 1


#: Decay inside a chunk, as a power of e: small, so that scales are exact to the last digits, while what lies two chunks back weighs less than 1e-21.
_CHUNK_DECAY = 50.0


def add_ewma_present(df: DataFrame, specs: Mapping[str, GapEwma], key: str = "ticker", pos: str = "_pos") -> DataFrame:
    """Add smoothed columns in which missing values leave gaps instead of counting as zeros.

    With y the last smoothed value, g the positions since then and q = 1 - alpha, a present x gives
    (q^g * y + alpha * x) / (q^g + alpha); the first one is taken as it is. A row without a value repeats y, and rows
    before `min_periods` present values get NULL. `pos` is an integer position per key. NULL and NaN are missing.

    Unrolled, every x has the weight alpha / (q^g + alpha) times the product of all later q^g / (q^g + alpha). Such
    a product is q to the number of values times a factor for the gaps, whose logarithm is a running sum; so a series
    without gaps keeps full precision. Weighted values are summed in chunks of bounded decay, each scaled from its own
    first row, and the chunk before is carried over; no value loses its weight to a long gap.
    """
    at = f"OVER (PARTITION BY {key} ORDER BY {pos}"
    own = [f"`{c}`" for c in df.columns if c not in specs]
    all_ = [(i, n, s, repr(-math.log1p(-s.alpha)) + "D", repr(s.alpha) + "D") for i, (n, s) in enumerate(specs.items())]
    so_far = f"{at} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    d = df.selectExpr("*", *[f"nanvl(CAST({s.value} AS DOUBLE), CAST(NULL AS DOUBLE)) AS _v{i}" for i, _, s, _, _ in all_])
    d = d.selectExpr("*", *[e for i, *_ in all_ for e in (
        f"count(_v{i}) {so_far} AS _k{i}",
        f"{pos} - max(CASE WHEN _v{i} IS NOT NULL THEN {pos} END) {at} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _g{i}")])
    # -ln of the factor of a gap, and the weight of the new value
    d = d.selectExpr("*", *[e for i, _, _, rate, alpha in all_ for e in (
        f"CASE WHEN _v{i} IS NULL OR _g{i} IS NULL OR _g{i} = 1 THEN 0D ELSE (_g{i} - 1) * {rate} + ln({alpha} + exp(-_g{i} * {rate})) END AS _a{i}",
        f"CASE WHEN _v{i} IS NULL THEN 0D WHEN _g{i} IS NULL THEN _v{i} WHEN _g{i} = 1 THEN _v{i} * {alpha} "
        f"ELSE _v{i} * ({alpha} / ({alpha} + exp(-_g{i} * {rate}))) END AS _b{i}")])
    d = d.selectExpr("*", *[f"sum(_a{i}) {so_far} AS _r{i}" for i, *_ in all_])
    d = d.selectExpr("*", *[f"CAST(floor((_k{i} * {rate} + _r{i}) / {_CHUNK_DECAY}) AS BIGINT) AS _c{i}" for i, _, _, rate, _ in all_])
    inside = {i: f"OVER (PARTITION BY {key}, _c{i} ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for i, *_ in all_}
    d = d.selectExpr("*", *[e for i, *_ in all_ for e in (f"first(_k{i}) {inside[i]} AS _k0{i}", f"first(_r{i}) {inside[i]} AS _r0{i}")])
    d = d.selectExpr("*", *[f"exp((_k{i} - _k0{i}) * {rate} + (_r{i} - _r0{i})) AS _up{i}" for i, _, _, rate, _ in all_])
    d = d.selectExpr("*", *[f"sum(_b{i} * _up{i}) {inside[i]} AS _in{i}" for i, *_ in all_])
    before = {i: f"OVER (PARTITION BY {key} ORDER BY _c{i} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)" for i, *_ in all_}
    d = d.selectExpr("*", *[e for i, *_ in all_ for e in (
        f"sum(_b{i} * _up{i}) {before[i]} AS _pre{i}", f"min(_k0{i}) {before[i]} AS _kp{i}", f"min(_r0{i}) {before[i]} AS _rp{i}")])
    carried = {i: f"coalesce(_pre{i} * exp(-((_k0{i} - _kp{i}) * {rate} + (_r0{i} - _rp{i}))), 0D)" for i, _, _, rate, _ in all_}
    return d.selectExpr(*own, *[f"CASE WHEN _k{i} >= {max(1, s.min_periods)} THEN (_in{i} + {carried[i]}) / _up{i} END AS {n}" for i, n, s, _, _ in all_])
