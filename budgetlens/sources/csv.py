"""Read budget CSV files into the declared fact schema.

The CSV is read with every column as text (no inference pass over the data),
header names are cleaned (S3), missing-value tokens become NULL and each
declared column is ``try_cast`` to its type, so a bad cell is NULL rather than
a failed job. S7 then decides which rows are good.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.schema import FACT_SCHEMA, NA_TOKENS


def clean_name(name: str) -> str:
    """S3: trim, spaces (line breaks too) to '_', drop '(' and ')'."""
    return re.sub(r"\r\n|[\r\n ]", "_", name.strip()).replace("(", "").replace(")", "")


def clean_columns(df: DataFrame) -> DataFrame:
    """S3: rename every column with ``clean_name`` (metadata only)."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def raw_name(name: str) -> str:
    """Inverse of the cleaning for the fact columns, the way the source CSV
    spells them: '_' as spaces and a trailing unit in brackets
    (``Allocated_Budget_Cr`` -> ``Allocated Budget (Cr)``)."""
    parts = name.split("_")
    if len(parts) > 1 and parts[-1] == "Cr":
        return " ".join(parts[:-1]) + " (Cr)"
    return " ".join(parts)


def null_tokens(col: str, tokens: Iterable[str] = NA_TOKENS, trim: bool = False) -> Column:
    """A text cell that is blank or a missing-value token becomes NULL. ``trim``
    (for columns that are not text) ignores white space around the token."""
    c = F.col(f"`{col}`")
    cell = F.trim(c) if trim else c
    return F.when(cell.isin(list(tokens)) | (F.trim(c) == ""), F.lit(None).cast("string")).otherwise(c)


def typed(cell: Column, kind: T.DataType) -> Column:
    """A text cell as ``kind``, NULL where it cannot be read. Integer columns
    also take whole numbers written with a fraction (``45.0``)."""
    if isinstance(kind, T.StringType):
        return cell
    direct = F.trim(cell).try_cast(kind)
    if not isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        return direct
    wide = F.trim(cell).try_cast("decimal(38,10)")
    return F.coalesce(direct, F.when(wide == F.floor(wide), F.floor(wide).try_cast(kind)))


def first_existing(spark: SparkSession, candidates: Iterable[str]) -> str | None:
    """The first candidate path (or glob) that matches anything, through
    the Hadoop file system of the path, so it works for any cluster store."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    for cand in candidates:
        path = jvm.org.apache.hadoop.fs.Path(cand)
        found = path.getFileSystem(conf).globStatus(path)
        if found is not None and len(found) > 0:
            return cand
    return None


#: Files whose headers are read at a time, and the longest header (lines).
HEADER_THREADS, HEADER_LINES = 32, 1000


def _header_text(lines) -> str:
    """The first record of a reader: lines until all quotes are closed (the
    first line, if they never are)."""
    first = lines.readLine() or ""
    text = first
    for _ in range(HEADER_LINES):
        if text.count('"') % 2 == 0:
            return text
        more = lines.readLine()
        if more is None:
            break
        text += "\n" + more
    return first


def csv_headers(spark: SparkSession, paths: Iterable[str]) -> dict[tuple[str, ...], list[str]]:
    """Files (``*.csv`` of folders, globs) by their header, which may hold line
    breaks in quoted names. Headers are read through the Hadoop file system of
    the path, many files at a time; a file without a line has no rows and is
    left out."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    files = []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        for found in fs.globStatus(path) or []:
            for f in fs.listStatus(found.getPath()) if found.isDirectory() else [found]:
                if not f.isDirectory() and f.getPath().getName().endswith(".csv"):
                    files.append((fs, f.getPath()))

    def header(file) -> str:
        fs, at = file
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
        try:
            return _header_text(lines)
        finally:
            lines.close()

    out: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        for (_, at), first in zip(files, pool.map(header, files)):
            if first:
                names = next(csv.reader(io.StringIO(first.removeprefix("\ufeff"), newline="")))
                out.setdefault(tuple(names), []).append(at.toString())
    return out


def read_budget(spark: SparkSession, paths: str | list[str], *,
                with_source: bool = False, na_tokens: Iterable[str] = NA_TOKENS,
                keep_extra: bool = False, multi_line: bool = True) -> DataFrame:
    """S1 + S2: read every CSV matched by ``paths`` (files, folders or globs;
    folders contribute their ``*.csv`` files) into FACT_SCHEMA.

    Files are read per header and united by column name, so column order and
    missing columns may differ between files. Declared columns that no file
    has are NULL; undeclared columns are dropped unless ``keep_extra``.
    ``with_source`` adds the file name each row came from (``Source_File``).
    Quotes are doubled inside quoted cells; with ``multi_line`` (the default)
    a quoted cell may hold line breaks, and a file is then read by one task:
    large inputs should be many files, or ``multi_line=False`` (files whose
    header holds a line break are read that way all the same). A file whose
    header names no declared column is an error, not a table of NULLs.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    declared = {f.name for f in FACT_SCHEMA.fields}
    for header, files in csv_headers(spark, paths).items():
        if declared.isdisjoint(clean_name(c) for c in header):
            raise ValueError(f"no column of the facts in the header {list(header)[:5]} of {files[0]}")
        raw = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
               .option("multiLine", multi_line or any("\n" in c for c in header)).option("mode", "PERMISSIVE").option("nullValue", "")
               .schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(files))
        if with_source:
            raw = raw.withColumn("_source_file", F.col("_metadata.file_name"))
        parts.append(_declared(clean_columns(raw), na_tokens, keep_extra, with_source))
    if not parts:
        empty = spark.createDataFrame([], FACT_SCHEMA)
        return empty.withColumn("Source_File", F.lit(None).cast("string")) if with_source else empty
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _declared(raw: DataFrame, na_tokens, keep_extra: bool, with_source: bool) -> DataFrame:
    present = set(raw.columns)
    cols = []
    for field in FACT_SCHEMA.fields:
        text = isinstance(field.dataType, T.StringType)
        if field.name in present:
            cols.append(typed(null_tokens(field.name, na_tokens, trim=not text), field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    if keep_extra:
        declared = {f.name for f in FACT_SCHEMA.fields} | {"_source_file"}
        cols += [null_tokens(c, na_tokens).alias(c) for c in raw.columns if c not in declared]
    if with_source:
        cols.append(F.col("_source_file").alias("Source_File"))
    return raw.select(*cols)


def write_budget_csv(df: DataFrame, path: str, null_token: str = "NA") -> str:
    """Write facts as CSV with the source's raw header spelling (for round
    trips and hand-offs); NULL is written as ``null_token``."""
    out = df.toDF(*[raw_name(c) for c in df.columns])
    (out.write.mode("overwrite").option("header", True)
        .option("escape", '"').option("nullValue", null_token).csv(path))
    return path
