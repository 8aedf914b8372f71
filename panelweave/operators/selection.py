"""Exact order statistics by radix selection: no sort, no copy of the data.

Values fall into bins that follow their order: a logarithmic grid at first, then equal parts of
the range that a bin was seen to span. One pass counts the rows of all bins; the next one looks only into the bins
that hold a wanted rank, so each pass shrinks what is left by orders of magnitude, whatever the number of
rows. Bins are found from the value alone, in generated code, and counted by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.session import shared_root

#: Parts of a factor of two in the first pass, and of a bin's range in later ones.
GRID, PARTS = 256, 1024
#: Rows of a bin that are ranked one by one; larger bins are cut again.
SMALL = 4096
#: The same for groups, where bins are ranked on the cluster.
GROUP_SMALL = 1_000_000


def order_bin(x: Column, grid: int = GRID) -> Column:
    """Bin of a double on the first grid: never falls as the value grows."""
    x = x.cast("double")
    return (F.signum(x) * F.floor(F.log2(F.abs(x) * 1048576.0 + 1.0) * grid)).cast("bigint")


def part_bin(x: Column, lo: Column, hi: Column) -> Column:
    """Bin of a double among equal parts of [lo, hi]; 0 where both are the same."""
    return F.when(lo < hi, F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("bigint")


@dataclass
class _Bracket:
    """Rows that still may hold a wanted rank: fixed values of the first columns, then a range of the next one."""

    fixed: tuple = ()
    lo: float | None = None
    hi: float | None = None

    def key(self):
        return self.fixed, self.lo, self.hi

    def rows(self, cols: Sequence[Column]) -> Column:
        cond = F.lit(True)
        for c, v in zip(cols, self.fixed):
            cond = cond & c.eqNullSafe(F.lit(v))
        if self.lo is not None:
            cond = cond & cols[len(self.fixed)].between(F.lit(self.lo), F.lit(self.hi))
        return cond

    def bin(self, cols: Sequence[Column]) -> Column:
        c = cols[len(self.fixed)]
        return order_bin(c) if self.lo is None else part_bin(c, F.lit(self.lo), F.lit(self.hi))


@dataclass
class _Wanted:
    rank: int
    place: int = 0
    rank_in: int = 0
    bracket: _Bracket = field(default_factory=_Bracket)
    size: int | None = None


def select_rows(df: DataFrame, requests: Mapping[str, tuple[Sequence[str], Callable[[int], Sequence[int]]]]) -> dict[str, tuple[int, list[tuple]]]:
    """The rows at wanted ranks in the order of some columns, for several orders in the same passes.

    `requests` maps a name to its columns (numbers or days, compared as doubles, ascending) and a function
    from the number of rows to the wanted ranks, from 0 up. Rows whose first column is NULL are left out. Returns for each name the number
    of rows and a tuple of doubles per rank. The driver sees counts of bins that hold a wanted rank and at most
    `SMALL` rows for each.
    """
    cols = {name: [_number(df, c) for c in names] for name, (names, _) in requests.items()}
    wanted: dict[str, list[_Wanted]] = {name: [_Wanted(-1)] for name in requests}
    total: dict[str, int] = {}
    found: dict[str, dict[int, tuple]] = {name: {} for name in requests}
    while any(wanted.values()):
        counts, small, brackets = [], [], {}
        for name, open_ in wanted.items():
            groups = {w.bracket.key(): w for w in open_}
            for i, w in enumerate(groups.values()):
                brackets[name, w.bracket.key()] = i
                tag = [F.lit(name).alias("name"), F.lit(i).alias("bracket")]
                hit = w.bracket.rows(cols[name]) & cols[name][0].isNotNull()
                if w.size is not None and w.size <= SMALL:
                    small.append(F.when(hit, F.struct(*tag, F.array(*cols[name]).alias("row"))))
                else:
                    counts.append(F.when(hit, F.struct(*tag, w.bracket.bin(cols[name]).alias("bin"), cols[name][len(w.bracket.fixed)].alias("x"))))
        bins: dict[tuple, list] = {}
        rows: dict[tuple, list] = {}
        if counts:
            hist = df.select(F.explode(F.filter(F.array(*counts), lambda s: s.isNotNull())).alias("s")).select("s.*")
            for r in hist.groupBy("name", "bracket", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
                bins.setdefault((r["name"], r["bracket"]), []).append((r["bin"], r["n"], r["lo"], r["hi"]))
        if small:
            picked = df.select(F.explode(F.filter(F.array(*small), lambda s: s.isNotNull())).alias("s")).select("s.*")
            for r in picked.collect():
                rows.setdefault((r["name"], r["bracket"]), []).append(tuple(r["row"]))
        for got in rows.values():
            got.sort(key=lambda t: tuple((v is not None, v) for v in t))  # NULLs first, as Spark sorts
        for name, open_ in wanted.items():
            after = []
            for w in open_:
                at = name, brackets[name, w.bracket.key()]
                if w.rank < 0:  # the first pass only: now the number of rows is known
                    seen = sorted(bins.get(at, []))
                    total[name] = sum(n for _, n, _, _ in seen)
                    ranks = requests[name][1](total[name]) if total[name] else []
                    todo = [_Wanted(r, i, r) for i, r in enumerate(ranks)]
                elif at in rows:
                    found[name][w.place] = rows[at][w.rank_in]
                    continue
                else:
                    seen, todo = sorted(bins[at], key=lambda b: (b[0] is not None, b[0])), [w]
                for x in todo:
                    before = 0
                    for bin_, n, lo, hi in seen:
                        if x.rank_in < before + n:
                            break
                        before += n
                    x.rank_in -= before
                    x.size = n
                    fixed = x.bracket.fixed
                    x.bracket = _Bracket((*fixed, lo)) if bin_ is None or lo == hi else _Bracket(fixed, lo, hi)
                    if len(x.bracket.fixed) == len(cols[name]):
                        found[name][x.place] = x.bracket.fixed
                    else:
                        after.append(x)
            wanted[name] = after
    return {name: (total.get(name, 0), [found[name][i] for i in sorted(found[name])]) for name in requests}


def _number(df: DataFrame, column: str) -> Column:
    """A numeric column, or the day number of a date, as a double; a missing tie breaker comes first."""
    kind = df.schema[column].dataType.typeName()
    c = F.unix_date(column) if kind == "date" else F.col(column)
    return c.cast("double")


def quantile_bounds(df: DataFrame, orders: Mapping[str, Sequence[str]], q: int) -> dict[str, list[tuple]]:
    """For each order, the rows at which bins of equal rank width begin: bin b takes ranks r (from 0) with b < r * q / (n - 1) <= b + 1."""
    def starts(n: int) -> list[int]:
        return [min(n - 1, b * (n - 1) // q + 1) for b in range(1, q)] if n > 1 else []

    got = select_rows(df, {name: (cols, starts) for name, cols in orders.items()})
    return {name: rows for name, (_, rows) in got.items()}


def bin_of(df: DataFrame, columns: Sequence[str], starts: Sequence[tuple]) -> Column:
    """Number of the bin that a row lies in: how many of the starts are not behind it."""
    cols = [_number(df, c) for c in columns]

    def reached(start: tuple) -> Column:
        cond = F.lit(True)
        for c, v in reversed(list(zip(cols, start))):
            after = c.isNotNull() if v is None else F.coalesce(c > F.lit(v), F.lit(False))
            cond = after | (c.eqNullSafe(F.lit(v)) & cond)
        return cond

    return sum((F.when(reached(s), 1).otherwise(0) for s in starts), F.lit(0)).cast("int")


def interpolated(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Linear-interpolation quantiles of whole columns, a few numbers each, in passes that the columns share."""
    def ends(n: int) -> list[int]:
        return [k for p in probs for k in _neighbours(p, n)]

    got = select_rows(df, {c: ([c], ends) for c in columns})
    out = {}
    for c, (n, rows) in got.items():
        pairs = zip(rows[::2], rows[1::2])
        out[c] = [a + (b - a) * (p * (n - 1) - int(p * (n - 1))) for p, ((a,), (b,)) in zip(probs, pairs)]
    return out


def _neighbours(p: float, n: int) -> tuple[int, int]:
    at = p * (n - 1)
    return int(at), min(n - 1, int(at) + (at > int(at)))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], raw_keys: Sequence[str] | None = None,
                    spread: Callable[[DataFrame, list[str]], DataFrame] | None = None, counts: DataFrame | None = None,
                    grid: int = GRID, small: int = GROUP_SMALL) -> DataFrame:
    """Linear-interpolation quantiles per key as rows (keys, prob, q), by the same selection on the cluster.

    Keys times bins must stay a table of moderate size (days, bands, columns); a key may hold any share of the rows. Where groups
    overlap, rows are counted by `raw_keys` and `spread(counts, more_keys)` adds the counts `n` up for `keys`. `counts` may bring
    the first pass, made by the caller in a pass of its own: raw keys, _path, n, lo, hi.
    """
    shared_root(df.sparkSession)
    keys, raw = list(keys), list(raw_keys or keys)
    rows = df.where(F.col(value).isNotNull()).select(*raw, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_path", F.array(order_bin(F.col("_v"), grid)))

    def by_group(c: DataFrame) -> DataFrame:
        if spread is None:
            return c
        ends = c.groupBy("_path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return spread(c.select(*raw, "_path", "n"), ["_path"]).join(ends, "_path")

    every = F.array(*[F.lit(float(p)) for p in sorted(set(probs))])
    hist = by_group(_counted(rows, raw) if counts is None else counts)
    group, up = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_path").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumns({"n_before": F.coalesce(F.sum("n").over(up), F.lit(0)), "n_group": F.sum("n").over(group)})
    at = lambda p: p * (F.col("n_group") - 1)
    near = lambda p: (F.col("n_before") <= F.ceil(at(p))) & (F.floor(at(p)) < F.col("n_before") + F.col("n"))
    # bins with a wanted rank: at most two for each key and probability
    wanted = hist.withColumn("prob", F.explode(F.filter(every, near))).withColumns(
        {"_lo": F.floor(at(F.col("prob"))), "_hi": F.ceil(at(F.col("prob"))), "_fr": at(F.col("prob")) - F.floor(at(F.col("prob")))}).checkpoint()
    while not wanted.where((F.col("n") > small) & (F.col("lo") < F.col("hi"))).isEmpty():
        rows = rows.join(wanted.select("_path", "lo", "hi").distinct() if spread else wanted.select(*keys, "_path", "lo", "hi").distinct(),
                         ["_path"] if spread else [*keys, "_path"])
        rows = rows.withColumn("_path", F.concat("_path", F.array(part_bin(F.col("_v"), F.col("lo"), F.col("hi"))))).drop("lo", "hi")
        hist = by_group(_counted(rows, raw)).withColumn("_up", F.slice("_path", F.lit(1), F.size("_path") - 1))
        inner = W.partitionBy(*keys, "_up").orderBy("_path").rowsBetween(W.unboundedPreceding, -1)
        hist = hist.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        outer = wanted.select(*keys, F.col("_path").alias("_up"), "n_before", "n_group", "prob", "_lo", "_hi", "_fr")
        wanted = hist.join(outer, [*keys, "_up"]).withColumn("n_before", F.col("n_before") + F.col("_in")).where(
            (F.col("n_before") <= F.col("_hi")) & (F.col("_lo") < F.col("n_before") + F.col("n"))).drop("_up", "_in").checkpoint()
    # the values of the last bins, equal ones folded
    on = ["_path"] if spread else [*keys, "_path"]
    ties = rows.join(wanted.select(*on).distinct(), on).groupBy(*raw, "_path", "_v").agg(F.count("*").alias("n"))
    if spread:
        ties = spread(ties, ["_path", "_v"])
    ties = ties.join(wanted.select(*keys, "_path", "n_before").distinct(), [*keys, "_path"])
    run = W.partitionBy(*keys, "_path").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ties = ties.withColumn("_end", F.col("n_before") + F.sum("n").over(run)).select(*keys, "_path", "_v", F.col("n").alias("_t"), "_end")
    m = ties.join(wanted.select(*keys, "_path", "prob", "_lo", "_hi", "_fr"), [*keys, "_path"])
    pick = lambda k: F.max(F.when((F.col("_end") - F.col("_t") <= F.col(k)) & (F.col(k) < F.col("_end")), F.col("_v")))
    return m.groupBy(*keys, "prob").agg(pick("_lo").alias("_a"), pick("_hi").alias("_b"), F.max("_fr").alias("_f")).select(
        *keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("q"))


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "_path").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
