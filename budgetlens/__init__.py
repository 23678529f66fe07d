"""budgetlens: public-budget analytics as Spark DataFrame jobs.

DataFrame in, DataFrame out. ``sources`` builds and reads the fact table,
``operators`` holds the reports, ``functions`` the Column helpers, ``plans``
the plan checks, ``streaming`` the alert job.
"""

from budgetlens.schema import FACT_COLUMNS, FACT_SCHEMA  # noqa: F401

__all__ = ["FACT_COLUMNS", "FACT_SCHEMA"]
