"""Exact statistics of sliding frames of rows, with constant work per row and no subtraction.

The rows of a key are cut into blocks as long as the frame. A frame then is the end of one block
and the beginning of the next: its statistics are those of a running aggregate from the end of
the one block, merged with a running aggregate from the beginning of the other. Counts, means and central
moments are merged, never taken away, so a NaN or a very large value leaves the frame with its row
and nothing is lost to cancellation.

Values that are NULL, NaN or infinite are missing: they count in no statistic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F


def finite_sql(expr: str) -> str:
    """SQL text: the value as a double, NULL where it is NaN or infinite."""
    x = f"CAST({expr} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) <> double('infinity') THEN {x} END"


def _merged(n1: str, m1: str, n2: str, m2: str) -> str:
    """Mean of two parts; either may be empty."""
    return f"CASE WHEN {n1} = 0 THEN {m2} WHEN {n2} = 0 THEN {m1} ELSE {m1} + ({m2} - {m1}) * ({n2} / ({n1} + {n2})) END"


def _moment(n1: str, a1: str, b1: str, c1: str, n2: str, a2: str, b2: str, c2: str) -> str:
    """Sum of products of deviations of two parts, from their counts, means of both factors and own sums."""
    return (f"CASE WHEN {n1} = 0 THEN {c2} WHEN {n2} = 0 THEN {c1} "
            f"ELSE {c1} + {c2} + ({a2} - {a1}) * ({b2} - {b1}) * ({n1} * CAST({n2} AS DOUBLE) / ({n1} + {n2})) END")


def add_frame_moments(df: DataFrame, values: Mapping[str, str], rows: int, ends_before: int = 0,
                      pairs: Mapping[str, tuple[str, str]] | None = None, key: str = "ticker", date: str = "date") -> DataFrame:
    """Add statistics over the `rows` rows that end `ends_before` rows before each row.

    For each name of `values` (SQL text): `<name>_n` (values present), `<name>_mean` (NULL without any) and `<name>_m2` (sum of
    squared deviations). For each name of `pairs` (two SQL texts x and y): `<name>_n` (rows with both), `<name>_mx`, `<name>_my`,
    `<name>_m2y` and `<name>_c` (sum of products of deviations), over rows that have both. `_rows` counts the rows of the frame,
    which are fewer at the start of a key. One shuffle by key; (key, date) must be unique.
    """
    pairs = dict(pairs or {})
    own = [f"`{c}`" for c in df.columns]
    at = f"OVER (PARTITION BY {key} ORDER BY {date})"
    inputs, stats = [], {}  # @ stands for the window
    for i, (name, expr) in enumerate(values.items()):
        inputs.append(f"{finite_sql(expr)} AS _v{i}")
        stats |= {f"n{i}": f"count(_v{i}) @", f"a{i}": f"avg(_v{i}) @", f"s{i}": f"var_pop(_v{i}) @ * count(_v{i}) @"}
    for i, (name, (x, y)) in enumerate(pairs.items()):
        fx, fy = finite_sql(x), finite_sql(y)
        inputs += [f"CASE WHEN ({fy}) IS NOT NULL THEN {fx} END AS _x{i}", f"CASE WHEN ({fx}) IS NOT NULL THEN {fy} END AS _y{i}"]
        stats |= {f"p{i}": f"count(_x{i}) @", f"x{i}": f"avg(_x{i}) @", f"y{i}": f"avg(_y{i}) @",
                  f"q{i}": f"var_pop(_y{i}) @ * count(_y{i}) @", f"c{i}": f"covar_pop(_x{i}, _y{i}) @ * count(_x{i}) @"}
    block = f"CAST(_p / {rows} AS BIGINT)"
    ahead = f"OVER (PARTITION BY {key}, _block ORDER BY {date} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    behind = f"OVER (PARTITION BY {key}, _block ORDER BY {date} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    d = df.selectExpr("*", *inputs, f"row_number() {at} - 1 AS _p")
    d = d.selectExpr("*", f"{block} AS _block")
    d = d.selectExpr("*", *[f"{e.replace('@', behind)} AS _z_{s}" for s, e in stats.items()])
    d = d.selectExpr("*", *[f"{e.replace('@', ahead)} AS _h_{s}" for s, e in stats.items()])
    # the part in the block before begins rows - 1 rows earlier; a row at the end of its block has its whole frame there
    part = lambda s: f"CASE WHEN _p % {rows} <> {rows - 1} THEN lag(_z_{s}, {rows - 1}) {at} END"
    d = d.selectExpr("*", *[f"coalesce({part(s)}, 0) AS _t_{s}" if s[0] in "np" else f"{part(s)} AS _t_{s}" for s in stats])

    def two(*names: str) -> list[str]:
        return [f"_t_{n}" for n in names] + [f"_h_{n}" for n in names]

    out = {"_rows": f"least(_p + 1, {rows})"}
    for i, name in enumerate(values):
        (n1, a1, s1, n2, a2, s2) = two(f"n{i}", f"a{i}", f"s{i}")
        out |= {f"{name}_n": f"{n1} + {n2}", f"{name}_mean": _merged(n1, a1, n2, a2),
                f"{name}_m2": _moment(n1, a1, a1, s1, n2, a2, a2, s2)}
    for i, name in enumerate(pairs):
        (n1, x1, y1, q1, c1, n2, x2, y2, q2, c2) = two(f"p{i}", f"x{i}", f"y{i}", f"q{i}", f"c{i}")
        out |= {f"{name}_n": f"{n1} + {n2}", f"{name}_mx": _merged(n1, x1, n2, x2), f"{name}_my": _merged(n1, y1, n2, y2),
                f"{name}_m2y": _moment(n1, y1, y1, q1, n2, y2, y2, q2), f"{name}_c": _moment(n1, x1, y1, c1, n2, x2, y2, c2)}
    d = d.selectExpr(*own, *[f"{e} AS `{n}`" for n, e in out.items()])
    if not ends_before:
        return d
    # the frame that ended some rows ago
    late = [f"coalesce(lag(`{n}`, {ends_before}) {at}, 0) AS `{n}`" if n == "_rows" or n.endswith("_n") else f"lag(`{n}`, {ends_before}) {at} AS `{n}`" for n in out]
    return d.selectExpr(*own, *late)


def _running(x: np.ndarray, ok: np.ndarray, pairs: Sequence[tuple[int, int]], order) -> list[np.ndarray]:
    """Count, mean, sum of squared deviations and, for pairs of columns, sum of products of deviations of the rows of a block up to each one.

    `x` and `ok` (value present) are rows x blocks x columns; rows enter in `order`. The updates are those of the SQL aggregates.
    """
    n, total, avg, m2, c = (np.zeros(x.shape[1:]) for _ in range(5))
    c = c[:, : len(pairs)]
    a, b = [i for i, _ in pairs], [j for _, j in pairs]
    out = [np.empty(x.shape) for _ in range(3)] + [np.empty((*x.shape[:2], len(pairs)))]
    for o in order:
        there, v = ok[o], x[o]
        more = n + 1.0
        gap = v - avg
        part = gap / more
        new = avg + part
        if pairs:
            c = np.where(there[:, a], c + gap[:, a] * (v[:, b] - new[:, b]), c)
        m2 = np.where(there, m2 + gap * (gap - part), m2)
        n, total, avg = np.where(there, more, n), np.where(there, total + v, total), np.where(there, new, avg)
        out[0][o], out[1][o], out[2][o], out[3][o] = n, total / n, m2 / n * n, c / n[:, a] * n[:, a]
    return out


def array_moments(place: np.ndarray, values: np.ndarray, rows: int, pairs: Sequence[tuple[int, int]] = ()) -> tuple[np.ndarray, ...]:
    """:func:`add_frame_moments` over arrays, by the same steps: count, mean and m2 of each column, and c of each pair of columns.

    `place` counts the rows of a key from 0, `values` is rows x columns; whole keys come one after the other. The columns of a
    pair must be missing in the same rows. Without any value in its frame a row has the count 0, and its other numbers mean nothing.
    """
    at = place % rows
    block = np.cumsum(at == 0) - 1
    x = np.zeros((rows, block[-1] + 1 if len(block) else 0, values.shape[1]))
    ok = np.zeros(x.shape, bool)
    finite = np.isfinite(values)
    x[at, block], ok[at, block] = np.where(finite, values, 0.0), finite
    with np.errstate(all="ignore"):
        ahead = [s[at, block] for s in _running(x, ok, pairs, range(rows))]
        # the part in the block before begins rows - 1 rows earlier; a row at the end of its block has its whole frame there
        two = (place >= rows) & (at != rows - 1)
        behind = [s[np.where(two, at + 1, 0), np.where(two, block - 1, 0)] for s in _running(x, ok, pairs, range(rows - 1, -1, -1))]
        n1, n2 = np.where(two[:, None], behind[0], 0.0), ahead[0]
        (_, m1, s1, c1), (_, a2, s2, c2) = behind, ahead
        share = lambda k1, k2: k1 * k2 / (k1 + k2)
        pick = lambda k1, k2, left, right, both: np.where(k1 == 0, right, np.where(k2 == 0, left, both))
        gap = a2 - m1
        mean = pick(n1, n2, m1, a2, m1 + gap * (n2 / (n1 + n2)))
        m2 = pick(n1, n2, s1, s2, s1 + s2 + gap * gap * share(n1, n2))
        a, b = [i for i, _ in pairs], [j for _, j in pairs]
        c = pick(n1[:, a], n2[:, a], c1, c2, c1 + c2 + gap[:, a] * gap[:, b] * share(n1[:, a], n2[:, a]))
    return n1 + n2, mean, m2, c


_FIELDS = ("n", "mx", "my", "m2y", "c")


def _merge_sql(a: str, b: str) -> str:
    """SQL text: the moments of two neighbouring parts as one struct; a part that doesn't exist is NULL."""
    f = {s: [f"{s}.{k}" for k in _FIELDS] for s in (a, b)}
    (n1, x1, y1, q1, c1), (n2, x2, y2, q2, c2) = f[a], f[b]
    return (f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE named_struct('n', {n1} + {n2}, 'mx', {_merged(n1, x1, n2, x2)}, "
            f"'my', {_merged(n1, y1, n2, y2)}, 'm2y', {_moment(n1, y1, y1, q1, n2, y2, y2, q2)}, 'c', {_moment(n1, x1, y1, c1, n2, x2, y2, c2)}) END")


def add_doubling_moments(df: DataFrame, x: str, y: str, longest: int, key: str = "ticker", order: str = "date", out: str = "levels") -> DataFrame:
    """Add an array: element k holds the moments of x and y over the 2^k rows up to each row, for frames of up to `longest` rows.

    Each level is the one below merged with itself 2^(k-1) rows earlier, so all share one sort. Rows with x or y missing count in none.
    """
    own = [f"`{c}`" for c in df.columns]
    fx, fy = finite_sql(x), finite_sql(y)
    both = f"({fx}) IS NOT NULL AND ({fy}) IS NOT NULL"
    d = df.selectExpr("*", f"named_struct('n', CAST({both} AS BIGINT), 'mx', CASE WHEN {both} THEN {fx} END, 'my', CASE WHEN {both} THEN {fy} END, "
                           "'m2y', 0D, 'c', 0D) AS _s0")
    levels = max(1, longest.bit_length())
    for k in range(1, levels):
        d = d.selectExpr("*", f"lag(_s{k - 1}, {1 << (k - 1)}) OVER (PARTITION BY {key} ORDER BY {order}) AS _b")
        d = d.selectExpr("*", f"{_merge_sql('_b', f'_s{k - 1}')} AS _s{k}").drop("_b")
    return d.selectExpr(*own, f"array({', '.join(f'_s{k}' for k in range(levels))}) AS {out}")


def frame_moments(frames: DataFrame, levels: DataFrame, pos: str, length: str, on: str = "ticker", level_pos: str = "pos") -> DataFrame:
    """Moments of frames of any length, by a few lookups each: `frames` (distinct rows) and the columns n, mx, my, m2y, c.

    A frame of `length` rows that ends at `pos` is cut into pieces of 2^k rows, one for each binary digit of its
    length; each piece is an equi-join with the row that ends it in `levels` (from :func:`add_doubling_moments`).
    """
    own = [f"`{c}`" for c in frames.columns]
    pieces = frames.selectExpr("*", f"explode(filter(sequence(0, 62), k -> shiftright(CAST({length} AS BIGINT), k) & 1 = 1)) AS _k")
    pieces = pieces.selectExpr("*", f"CAST({pos} - ({length} & (shiftleft(1L, _k) - 1)) AS BIGINT) AS _end")
    have = levels.selectExpr(f"`{on}`", f"CAST({level_pos} AS BIGINT) AS _end", "levels")
    found = pieces.join(have, [on, "_end"]).selectExpr(*own, "struct(_end, levels[_k] AS m) AS _piece")
    merge = _merge_sql("a", "p.m")
    zero = "CAST(NULL AS STRUCT<n: BIGINT, mx: DOUBLE, my: DOUBLE, m2y: DOUBLE, c: DOUBLE>)"
    grouped = found.groupBy(*frames.columns).agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"))  # one for each digit at most
    return grouped.selectExpr(*own, f"aggregate(_pieces, {zero}, (a, p) -> {merge}) AS _m").selectExpr(*own, "_m.*")
