"""stratum: a Spark-native extraction and clean-layer analytics library.

Periodic analytics exports (workbooks in a category/year/month tree) are
discovered and read as one Spark job, typed through a fixed dataset registry,
stamped with their extraction date, repaired (negative daily metrics replaced
by a per-extraction moving average), unioned into monthly and whole-history
tables and appended incrementally to a partitioned clean layer.

Everything downstream of the workbook reader is expressed with DataFrame /
SQL primitives so Catalyst and AQE plan it.
"""

from stratum.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
