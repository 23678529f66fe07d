"""S4 + S7: a stored table whose versions are switched by one rename, and loads
that are checked before they are switched to.

A table folder holds

* ``data/<load>``: the good rows of a load, never changed once written,
* ``rejects/<load>``: its bad rows with their reasons,
* ``versions/<number>.json``: one small file per version, which names its data.

A load writes its checked rows once, good and bad ones apart (staged: no version
names them), counts the bad ones on what was written, moves the folder of the good
ones to its place if the load is accepted, and only then puts
the file of the next version in place by a rename that fails where the name is
taken. Readers take the version with the largest number, so they see the old
table or the new one, never a part; a load that is refused or dies on the way
leaves them the old one. Two loads at once cannot both take a number: the later
one is refused with ``CommitConflict``. (The rename is atomic on HDFS and local
file systems; an object store needs one whose connector offers that.)
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens.operators.quality import check_columns, checked_rows
from budgetlens.schema import FACT_COLUMNS, FACT_SCHEMA
from budgetlens.session import SMALL_TASKS, settings
from budgetlens.sources.sinks import PARTITION_COLUMNS, write_facts


class CommitConflict(RuntimeError):
    """Another load took the version number first."""


@dataclass(frozen=True)
class Load:
    """What became of a load; ``version`` is the table's version after it
    (None: there is no table yet)."""

    accepted: bool
    version: int | None
    records: int
    good: int
    bad: int
    reason: str | None
    data: str | None
    rejects: str | None


def _fs(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def _read_text(spark: SparkSession, path: str) -> str:
    fs, name = _fs(spark, path)
    stream = fs.open(name)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _version_numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _version_file(root: str, number: int) -> str:
    return f"{root}/versions/{number:012d}.json"


def version_info(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """What the file of a version says (the newest by default; None: no such version)."""
    numbers = _version_numbers(spark, root)
    if number is None:
        number = numbers[-1] if numbers else None
    if number is None or number not in numbers:
        return None
    return {"version": number, **json.loads(_read_text(spark, _version_file(root, number)))}


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The facts of a version, the newest by default. The version is chosen
    here: a load that ends later does not change what this plan reads."""
    info = version_info(spark, root, number)
    if info is None:
        raise FileNotFoundError(f"no version {'' if number is None else number} of the table at {root}")
    return spark.read.schema(FACT_SCHEMA).parquet(f"{root}/{info['data']}").select(*FACT_COLUMNS)


def _switch(spark: SparkSession, root: str, number: int, info: dict) -> None:
    """Put the file of version ``number`` in place; fails if the number is taken."""
    sc = spark.sparkContext
    jvm = sc._jvm
    fs, folder = _fs(spark, f"{root}/versions")
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/versions/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(info).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(_version_file(root, number))
    options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")  # never over an existing file
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), sc._jsc.hadoopConfiguration()) \
            .rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise CommitConflict(f"version {number} of {root} was committed by another load") from e
        raise


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder its place; an empty one where there is nothing to move."""
    fs, old = _fs(spark, source)
    _, new = _fs(spark, target)
    fs.mkdirs(new.getParent() if fs.exists(old) else new)
    if fs.exists(old) and not fs.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def load_facts(df: DataFrame, root: str, max_bad: int | None = None, max_bad_share: float | None = None,
               min_year: int = 1900, max_year: int = 2100) -> Load:
    """Replace the table at ``root`` by the rows of ``df`` that the row rules
    (``quality.checked_rows``) accept. The load is refused, and readers keep the
    version they have, where a column of the facts is missing, or where more
    rows than ``max_bad`` or a larger share than ``max_bad_share`` break a rule.
    Bad rows of every load are kept with their reasons."""
    spark = df.sparkSession
    numbers = _version_numbers(spark, root)
    base = numbers[-1] if numbers else None
    missing = [r["column"] for r in check_columns(df, FACT_COLUMNS).collect() if r["status"] != "found"]
    if missing:
        return Load(False, base, 0, 0, 0, f"missing columns: {', '.join(missing)}", None, None)
    name = uuid.uuid4().hex
    staged, rejects = f"data/{name}", f"rejects/{name}"
    # rows are written once, in the layout of the table; what was written is what is judged
    fs, folder = _fs(spark, f"{root}/staging/{name}")
    fs.mkdirs(folder)
    checked, good = f"{root}/staging/{name}/rows", F.size("reasons") == 0
    rows = checked_rows(df.select(*FACT_COLUMNS), min_year, max_year).withColumns(
        {"good": good, "bad_department": F.when(~good, F.col("Department"))})  # a folder's name does not hold ''
    with settings(spark, SMALL_TASKS):
        write_facts(rows, checked, mode="errorifexists", partition_by=["good", *PARTITION_COLUMNS], compression="zstd")
    written = spark.read.schema(rows.schema).parquet(checked)
    count = written.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("good"), 1)).alias("bad")).first()
    (written.where(~F.col("good")).withColumn("Department", F.col("bad_department")).select(*FACT_COLUMNS, "reasons")
     .write.parquet(f"{root}/{rejects}"))
    over = (f"{count.bad} of {count.n} rows break a rule" if max_bad is not None and count.bad > max_bad
            or max_bad_share is not None and count.bad > max_bad_share * count.n else None)
    if over is None:
        _move(spark, f"{checked}/good=true", f"{root}/{staged}")
    fs.delete(folder, True)
    if over is not None:
        return Load(False, base, count.n, 0, count.bad, over, None, rejects)
    number = (base or 0) + 1
    load = Load(True, number, count.n, count.n - count.bad, count.bad, None, staged, rejects)
    _switch(spark, root, number, {k: v for k, v in asdict(load).items() if k not in ("accepted", "version", "reason")} | {"at": time.time()})
    return load


def versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per version of the table, oldest first."""
    rows = [version_info(spark, root, n) for n in _version_numbers(spark, root)]
    return spark.createDataFrame([(r["version"], r["records"], r["good"], r["bad"], r["data"]) for r in rows],
                                 "version long, records long, good long, bad long, data string")


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than_hours: float = 24.0) -> list[str]:
    """Delete what no reader can need: versions before the newest ``keep`` and
    folders that no kept version names, both only when older than
    ``older_than_hours`` (a running load's folders are younger). Returns the
    deleted names."""
    numbers = _version_numbers(spark, root)
    kept = {version_info(spark, root, n)[k] for n in numbers[-keep:] for k in ("data", "rejects")}
    limit, gone = time.time() - older_than_hours * 3600, []
    for n in numbers[:-keep] if keep else numbers:
        fs, file = _fs(spark, _version_file(root, n))
        if version_info(spark, root, n)["at"] <= limit:
            fs.delete(file, False)
            gone.append(f"versions/{n}")
        else:
            kept |= {version_info(spark, root, n)[k] for k in ("data", "rejects")}
    for kind in ("data", "rejects", "staging"):
        fs, folder = _fs(spark, f"{root}/{kind}")
        for entry in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f"{kind}/{entry.getPath().getName()}"
            if name not in kept and entry.getModificationTime() / 1000 <= limit:
                fs.delete(entry.getPath(), True)
                gone.append(name)
    return gone
