"""Per-department top-k in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from budgetlens.functions.numeric import to_output


def top_per_department(f: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` projects of every department with the lowest utilization
    (then longest delay, then Project_ID).

    ``row_number() <= k`` plans as a partial ``WindowGroupLimit`` before the
    shuffle, so a department holding a third of all rows sends only ``k`` rows
    per map task to the final window, never the whole department.
    """
    w = Window.partitionBy("Department").orderBy(
        F.col("Utilization_Percentage").asc_nulls_first(),
        F.col("Delay_Days").desc_nulls_last(), F.col("Project_ID"))
    out = (f.select("Department", "Project_ID", "State", "District",
                    "Utilization_Percentage", "Delay_Days")
           .withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= k)
           .withColumn("rank", F.col("rank").cast("int")))
    return to_output(out.orderBy("Department", "rank"))
