"""Content digests, manifests and their verification, cell registry, golden comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files at a path."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checked_panel(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """A wide monthly CSV as (date, series_id, level); raises if the file's digest is not the one expected."""
    got = [r["sha256"] for r in file_digests(spark, path).limit(2).collect()]
    if got != [expected]:
        raise ValueError(f"{path}: digest {got} instead of {expected}")
    raw = spark.read.option("header", True).csv(path)
    date, *ids = raw.columns
    return raw.select(F.to_date(date).alias("date"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in ids]).unpivot("date", ids, "series_id", "level")


def series_digest(df: DataFrame, value: str) -> DataFrame:
    """(series_id, rows, first, last, sha256, year_sha256): digests over sorted ``date<tab>value`` lines with four decimals, whole and by year (8 digits).

    The whole digest is that of the years' full digests, so no series is gathered at once beyond a year.
    """
    line = F.concat_ws("\t", F.col("date").cast("string"), F.format_string("%.4f", F.col(value)))
    y = df.where(F.col(value).isNotNull()).groupBy("series_id", F.year("date").alias("year")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("h"), F.count("*").alias("k"), F.min("date").alias("a"), F.max("date").alias("b"))
    entry = F.array_sort(F.collect_list(F.struct("year", "h")))
    g = y.groupBy("series_id").agg(F.sum("k").alias("rows"), F.min("a").cast("string").alias("first"), F.max("b").cast("string").alias("last"), entry.alias("e"))
    return g.select("series_id", "rows", "first", "last", F.sha2(F.concat_ws("\n", F.transform("e", lambda x: x["h"])), 256).alias("sha256"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["year"], F.substring(x["h"], 1, 8)))).alias("year_sha256"))


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(series_id, state, years): IDENTICAL, SAME DATA (equal in all recorded years but the file has more), DIFFERENT with the years that differ, MISSING."""
    j = manifest.alias("m").join(found.alias("f"), "series_id", "left")
    old, new = F.col("m.year_sha256"), F.col("f.year_sha256")
    years = F.array_sort(F.filter(F.map_keys(old), lambda k: ~F.coalesce(F.try_element_at(old, k) == F.try_element_at(new, k), F.lit(False))))
    state = F.when(new.isNull(), "MISSING").when(F.col("m.sha256") == F.col("f.sha256"), "IDENTICAL").when(F.size(years) == 0, "SAME DATA").otherwise("DIFFERENT")
    return j.select("series_id", state.alias("state"), F.when(state == "DIFFERENT", years).alias("years"))


def refuse_to_shrink(old: DataFrame, new: DataFrame) -> None:
    """Raises if a manifest would lose a series."""
    lost = [r["series_id"] for r in old.join(new, "series_id", "left_anti").select("series_id").limit(5).collect()]
    if lost:
        raise ValueError(f"the manifest would lose {lost}")


def record_cells(cells: DataFrame, path: str, least: int = 50, enabled: bool = True) -> None:
    """Cells (family, cell_id, calendar_group, ..., series) of at least ``least`` finite values, by family; a family that is recorded again replaces itself alone. Nothing without ``enabled``."""
    if not enabled:
        return
    finite = F.filter("series", lambda x: x.isNotNull() & ~F.isnan(x))
    kept = cells.withColumn("series", finite).where(F.size("series") >= least)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family").parquet(path)


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """All recorded cells, with their family as text."""
    cells = spark.read.parquet(path)
    return cells.withColumn("family", F.col("family").cast("string"))


def harvest(cells: DataFrame, families: tuple[str, ...] = ()) -> DataFrame:
    """Cells (cell_id, calendar_group, series, start, stop) with ``n`` and their groups merged: groups recorded on one calendar, of one length and span, are one and share their draws.

    Raises if a family that must be there has no cell, or if a group holds cells of several lengths, which cannot share block starts.
    """
    if families:
        there = {r["family"] for r in cells.select("family").distinct().where(F.col("family").isin(*families)).collect()}
        if missing := sorted(set(families) - there):
            raise ValueError(f"no cells of {missing}")
    c = cells.withColumn("n", F.size("series"))
    # One row for each calendar and label of it.
    labels = c.select("n", "start", "stop", "calendar_group").distinct().groupBy("n", "start", "stop").agg(F.concat_ws("+", F.array_sort(F.collect_list("calendar_group"))).alias("merged"))
    keys = [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in ("n", "start", "stop")]
    out = c.alias("c").join(labels.alias("l"), keys[0] & keys[1] & keys[2]).select("c.*", "l.merged").drop("calendar_group").withColumnRenamed("merged", "calendar_group")
    if bad := [r["calendar_group"] for r in ragged(out).select("calendar_group").limit(5).collect()]:
        raise ValueError(f"cells of several lengths in {bad}")
    return out


def ragged(cells: DataFrame) -> DataFrame:
    """Calendar groups whose cells differ in length; there must be none."""
    g = cells.groupBy("calendar_group").agg(F.min(F.size("series")).alias("shortest"), F.max(F.size("series")).alias("longest"))
    return g.where("shortest <> longest")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one result that the other lacks, with ``side``; none if they are equal as bags."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def golden_lines(spark: SparkSession, path: str, ignore: tuple[str, ...] = ("data folder:", "runtime ", "panel: ")) -> DataFrame:
    """(file, line) of stored text reports without lines that may vary, right-trimmed."""
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.rtrim("value").alias("line"))
    for word in ignore:
        t = t.where(~F.ltrim("line").startswith(word))
    return t


def numbers(lines: DataFrame) -> DataFrame:
    """(file, key, tokens): numbers of each report line after its label."""
    found = F.regexp_extract_all("line", F.lit(r"[-+]?\d+(?:\.\d+)?%?"), F.lit(0))
    return lines.select("file", F.trim(F.regexp_extract("line", r"^([^0-9+\-]*)", 1)).alias("key"), found.alias("tokens")).where(F.size("tokens") > 0)
