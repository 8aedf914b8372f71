"""Readers: keyed price panels, alias resolution, tagged multi-file scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.functions import dates, numeric as N
from panelweave.operators.ordering import dedupe
from panelweave.session import shared_root

# Accepted names of each logical news column, in order of preference.
NEWS_ALIASES = {
    "ticker": ("stock_symbol", "ticker", "symbol", "stock", "code"),
    "date": ("date", "timestamp", "time", "published_at", "datetime", "day"),
    "title": ("article_title", "title", "headline", "header", "subject"),
    "content": ("article", "content", "body", "text", "summary", "news", "description"),
    "url": ("url", "link", "original_url", "href", "source_url"),
    "extra": ("extra_fields", "meta", "metadata", "info"),
}
# Accepted names of the result columns, then fragments used as a fallback.
RESULT_COLUMNS = {
    "pred": (("Pred_Return_%", "Pred_Return", "Predicted_Alpha_%", "Pred"), ("pred", "alpha")),
    "score": (("XGB_Rank_Score", "XGB_Rank", "Rank_Score", "Rank"), ("score", "rank")),
    "actual": (("Actual_20D_Return_%", "Actual_15D_Return_%", "Actual_Return_%", "Actual_Alpha_%", "Actual_Return",
                "Actual"), ("actual", "return")),
}
# Accepted names of the tracker columns.
TRACKER_COLUMNS = {
    "date": ("date",), "ticker": ("ticker", "symbol"), "current_price": ("current_price", "currentprice", "price", "close"),
    "pred_return_pct": ("pred_return", "pred_return_%", "pred_return_pct", "pred"),
    "rank_score": ("xgb_rank_score", "xgb_rank", "rank_score", "rank", "xgb_score"),
    "dollar_turnover": ("dollar_turnover", "turnover", "notional", "liquidity"),
}

BAR_COLUMNS = ("date", "open", "high", "low", "close", "volume")


class FileScan(NamedTuple):
    """`rows`: file, order (of the file by its path, then the place in it) and every column of any layout as text. `report`: file, length, problem (NULL if none)."""

    rows: DataFrame
    report: DataFrame

    def checked(self) -> DataFrame:
        """The rows; an error that names a few files if any could not be read."""
        bad = self.report.where("problem IS NOT NULL").limit(5).collect()
        if bad:
            raise ValueError("files that can't be read: " + "; ".join(f"{r['file']} ({r['problem']})" for r in bad))
        return self.rows


def scan_csv(spark: SparkSession, root: str, pattern: str | None = None, required: Sequence[str] = (), tidy: bool = False) -> FileScan:
    """CSV files of many layouts below a folder in one distributed scan.

    Each row is mapped by the header of its own file: the first line of every file is found by a partial aggregate, and
    columns by their place in it. The driver sees the distinct column names only, no file and no header. Files that can't be
    decoded or lack a `required` column are rows of the report and give no rows; Spark lists no files of zero bytes. `pattern` is a regular expression on
    the path; `tidy` compares names in lower case with underscores. Values may be quoted but don't span lines.
    """
    shared_root(spark)
    path = F.col("_metadata.file_path")
    wanted = F.lit(True) if pattern is None else path.rlike(pattern)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(wanted).select(
        path.alias("file"), F.col("_metadata.file_size").alias("length"))
    text = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(root).where(wanted)
    order = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    lines = text.select(path.alias("file"), order.alias("order"), "value")
    heads = lines.groupBy("file").agg(F.min(F.struct("order", "value")).alias("h")).select(
        "file", F.col("h.order").alias("first"), F.col("h.value").alias("header"))
    heads = heads.sort("file").withColumn("number", F.monotonically_increasing_id()).checkpoint()  # a row for each file
    width = heads.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    cells = F.array(*[f"c{i}" for i in range(width)])
    parsed = lambda df, c, *kept: df.select(*kept, F.inline(F.array(F.from_csv(c, schema))))  # noqa: E731  once a line: nothing is pushed below `inline`
    name = (lambda n: F.replace(F.lower(F.trim(n)), F.lit(" "), F.lit("_"))) if tidy else F.trim
    known = parsed(heads, "header", "file", "number", "first").withColumn("names", F.transform(cells, name)).withColumn(
        "missing", F.array_except(F.array(*[F.lit(n) for n in required]).cast("array<string>"), "names"))
    report = listed.join(known.select("file", "missing"), "file", "left").select("file", "length", F.when(
        F.col("missing").isNull(), "unreadable").when(F.size("missing") > 0, F.concat(F.lit("lacks "), F.array_join("missing", ", "))).alias("problem"))
    good = known.where(F.size("missing") == 0).select("file", "number", "first", "names")
    columns = [r[0] for r in good.select(F.explode("names").alias("n")).where("n <> ''").distinct().orderBy("n").collect()]
    place = lambda n: F.nullif(F.array_position("names", n), F.lit(0)).cast("int") - 1
    placed = good.select("file", "number", "first", *[place(n).alias(f"p{k}") for k, n in enumerate(columns)])
    body = parsed(lines.join(placed, "file").where(F.col("order") != F.col("first")), "value", "file", F.struct("number", "order.*").alias("order"), *[f"p{k}" for k in range(len(columns))])
    return FileScan(body.select("file", "order", *[F.get(cells, f"p{k}").alias(n) for k, n in enumerate(columns)]), report)


def read_bars(spark: SparkSession, path: str, suffix: str = "_daily", strict: bool = True) -> DataFrame:
    """CSV files as one panel: key from the `ticker` column or else from the path, bad dates dropped, last row per day kept.

    Columns are found by each file's own header in lower case, in any order; further ones (adjusted prices,
    indicators, macro columns) are kept as numbers, NULL for tickers without them. A file that can't be read or lacks a price column is
    an error, or is left out if not `strict` (`scan_csv(...).report` names it). Accepts `<key>_daily.csv` files,
    `file=<key>_daily` folders, and files of many keys with a `ticker` column. The position in the file decides which row of a day is the last.
    """
    scan = scan_csv(spark, path, None, BAR_COLUMNS, tidy=True)
    raw = scan.checked() if strict else scan.rows
    key = F.regexp_extract("file", rf"([^/=]+){suffix}[^/]*(?:/[^/]*)?$", 1)
    if "ticker" in raw.columns:
        key = F.coalesce(F.nullif(F.trim("ticker"), F.lit("")), key)
    others = [c for c in raw.columns if c not in ("file", "order", "date", "ticker")]
    df = raw.select(key.alias("ticker"), dates.day(F.col("date")).alias("date"), *[N.to_double(F.col(f"`{c}`")).alias(c) for c in others],
                    F.col("order").alias("_o"))
    df = df.where(F.col("date").isNotNull() & F.col("close").isNotNull())
    return dedupe(df, ["ticker", "date"], [F.col("_o").desc()]).drop("_o")


def resolve(columns: Sequence[str], aliases: Mapping[str, Sequence[str]], substring: bool = True) -> dict[str, str | None]:
    """Logical name to actual column: exact lower-case alias first, then alias as a fragment."""
    low = {c.lower(): c for c in columns}
    out: dict[str, str | None] = {}
    for want, names in aliases.items():
        hit = next((low[a] for a in names if a in low), None)
        if hit is None and substring:
            hit = next((low[c] for a in names for c in low if a in c), None)
        out[want] = hit
    return out


def canonicalize(df: DataFrame, aliases: Mapping[str, Sequence[str]] = NEWS_ALIASES) -> DataFrame:
    """Project to the logical names; logical columns without a source are NULL."""
    found = resolve(df.columns, aliases)
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(want) for want, c in found.items()])


def pick_column(columns: Sequence[str], candidates: Sequence[str], fragments: Sequence[str] = ()) -> str | None:
    """First exact candidate, then case-insensitive, then first column holding a fragment."""
    hit = next((c for c in candidates if c in columns), None)
    if hit is None:
        low = {c.lower(): c for c in columns}
        hit = next((low[c.lower()] for c in candidates if c.lower() in low), None)
    if hit is None and fragments:
        hit = next((c for c in columns if any(f in c.lower() for f in fragments)), None)
    return hit


def detect_signal_schema(columns: Sequence[str], required: Sequence[str] = ("pred", "score", "actual"),
                         loose: bool = False) -> dict[str, str | None]:
    """Names of the prediction, rank and actual columns; raises when a required one is missing."""
    found = {k: pick_column(columns, exact, frag if loose else ()) for k, (exact, frag) in RESULT_COLUMNS.items()}
    missing = [k for k in required if not found[k]]
    if missing:
        raise ValueError(f"no column for {missing} among {list(columns)}")
    return found


def read_signals(df: DataFrame, loose: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """pred, score and actual as doubles; rows without pred or score are dropped."""
    cols = detect_signal_schema(df.columns, loose=loose)
    num = lambda c: N.finite(F.col(f"`{c}`").try_cast("double"))
    return df.select(*keep, *[num(c).alias(k) for k, c in cols.items()]).dropna(subset=["pred", "score"])


def read_tracker(df: DataFrame) -> DataFrame:
    """Tracker columns by name, prediction and rank also by fragment; absent ones NULL."""
    found = resolve(df.columns, TRACKER_COLUMNS, substring=False)
    for k, fragments in (("pred_return_pct", ("pred", "alpha")), ("rank_score", ("score", "rank"))):
        found[k] = found[k] or pick_column(df.columns, (), fragments)
    col = lambda k: F.col(f"`{found[k]}`") if found[k] else F.lit(None)
    num = ("current_price", "pred_return_pct", "rank_score", "dollar_turnover")
    return df.select(dates.day(col("date").cast("string")).alias("date"), col("ticker").cast("string").alias("ticker"),
                     *[N.finite(col(k).try_cast("double")).alias(k) for k in num])


def read_tagged(spark: SparkSession, root: str, globs: Sequence[str], strict: bool = True) -> DataFrame:
    """Union of the CSV results whose file or folder name matches a pattern, tagged with `source_file`.

    Layouts may differ; columns that a file lacks are NULL. All files are read by one scan. A file that can't be read is an error,
    or is left out if not `strict`.
    """
    names = "|".join(g.replace(".", r"\.").replace("*", "[^/]*") for g in globs)
    scan = scan_csv(spark, root, f"/(?:{names})(?:/[^/]*)?$")
    if scan.report.isEmpty():
        raise ValueError("no result files found")
    rows = scan.checked() if strict else scan.rows
    return rows.withColumnRenamed("file", "source_file").drop("order")


def lag_publication(df: DataFrame, days: int = 45, date: str = "date") -> DataFrame:
    """Move a monthly series to the day it became public."""
    return df.withColumn(date, F.date_add(date, days))
