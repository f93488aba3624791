"""L1-L4: multi-line log records.

A record starts at every line matching the start pattern; other lines are
appended to the record before them.  ``stitch_lines`` numbers the records of a
log split by split: start lines are counted inside each split, and one row per
split tells how many records earlier splits began, so the lines that lead a
split join the record before it.  ``stitch`` does the same for texts that are
at hand as one value each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Record start patterns and timestamp formats.
SYNC_START = r"\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2},\d{3}"      # '%Y-%m-%d %H:%M:%S' + ',mmm'
CONTAINER_START = r"\[\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\]"  # '[%d/%b/%Y:%H:%M:%S %z]'


def stitch(files: DataFrame, start_pattern: Column | str | None, text_col: str = "text",
           anchored: bool = True) -> DataFrame:
    """L1/L2: one row per record with its position in the file.

    ``start_pattern`` NULL -> one record per line.  ``anchored``: the pattern
    must match at the start of a line (L1); otherwise anywhere in it (L2)."""
    text = F.regexp_replace(F.col(text_col), r"\r?\n$", "")
    by_line = F.split(text, r"\r?\n")
    if start_pattern is None:
        pieces = by_line
    else:
        pat = start_pattern if isinstance(start_pattern, Column) else F.lit(start_pattern)
        pat = F.regexp_replace(pat, r"^\^", "")   # the newline before the look-ahead anchors it
        look = F.concat(F.lit(r"\r?\n(?=" + ("" if anchored else r"[^\n]*")), pat, F.lit(")"))
        pieces = F.when(pat.isNull(), by_line).otherwise(F.split(text, look))
    out = files.select(*[c for c in files.columns if c != text_col], F.posexplode(pieces).alias("record_no", "record"))
    return (out.where(F.col("record") != "")
            .withColumn("n_lines", F.size(F.split("record", r"\n"))))


def stitch_lines(lines: DataFrame, start_pattern: Column | str | None, anchored: bool = True) -> DataFrame:
    """L1/L2 over lines (log, file, block, at, line): one row per record with its position in the log, numbered and cut as
    by ``stitch`` on the log's whole text.  Other columns must be the same for all lines of a log."""
    pat = start_pattern if isinstance(start_pattern, Column) else F.lit(start_pattern).cast("string")
    begins = F.rlike("line", F.concat(F.lit("^(?:" if anchored else "(?:"), F.regexp_replace(pat, r"^\^", ""), F.lit(")")))
    flagged = lines.withColumn("_start", F.when(pat.isNull(), 1).otherwise(begins.cast("int")))
    keep = [c for c in lines.columns if c not in ("log", "file", "block", "at", "line")]
    splits = flagged.groupBy("log", "file", "block").agg(F.sum("_start").alias("_n"))
    first = F.min(F.struct("file", "block", "at", "_start")).alias("first")
    orphan = flagged.groupBy("log").agg(first).select("log", (1 - F.col("first._start")).alias("_orphan"))
    before = (splits.withColumn("_before", F.sum("_n").over(W.partitionBy("log").orderBy("file", "block")) - F.col("_n"))
              .join(orphan, "log").select("log", "file", "block", (F.col("_before") + F.col("_orphan") - 1).alias("_before")))
    inside = F.sum("_start").over(W.partitionBy("log", "file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    numbered = (flagged.withColumn("_in", inside).join(before, ["log", "file", "block"])
                .withColumn("record_no", (F.col("_in") + F.col("_before")).cast("int")))
    out = numbered.groupBy("log", *keep, "record_no").agg(
        F.array_sort(F.collect_list(F.struct("file", "block", "at", "line"))).alias("_lines"))
    return (out.withColumn("record", F.regexp_replace(F.array_join("_lines.line", "\n"), r"\r$", "")).where("record != ''")
            .select("log", *keep, "record_no", "record", F.size("_lines").alias("n_lines")))


def sync_timestamp(record: Column) -> Column:
    """L3: ``yyyy-MM-dd HH:mm:ss,SSS`` at the start of the record (UTC wall time, NTZ)."""
    raw = F.regexp_extract(record, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3})", 1)
    return F.try_to_timestamp(F.nullif(raw, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def container_timestamp(record: Column) -> Column:
    """L3: ``[dd/MMM/yyyy:HH:mm:ss +hhmm]`` -> UTC wall time (NTZ), offset applied."""
    local = F.regexp_extract(record, r"\[(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}) ([+-])(\d{2})(\d{2})\]", 1)
    sign = F.regexp_extract(record, r"\[[^\]]* ([+-])(\d{2})(\d{2})\]", 1)
    hh = F.regexp_extract(record, r"\[[^\]]* [+-](\d{2})(\d{2})\]", 1)
    mm = F.regexp_extract(record, r"\[[^\]]* [+-](\d{2})(\d{2})\]", 2)
    ntz = F.try_to_timestamp(F.nullif(local, F.lit("")), F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz")
    minutes = (F.when(sign == "-", -1).otherwise(1) * (hh.cast("int") * 60 + mm.cast("int")))
    return ntz - F.make_dt_interval(mins=minutes)


def log_group(prefix: str, mirror: Column) -> Column:
    """L4: ``<prefix>/mirrors/<name>``."""
    return F.concat(F.lit(prefix + "/mirrors/"), mirror)
