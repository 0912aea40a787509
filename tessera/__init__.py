"""tessera — multilingual document-topic preparation and evaluation on Spark.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregates and windows.  Nothing is collected to
the driver except metadata whose size is checked first (class lists,
per-partition counts).
"""

from tessera.session import get_spark, ensure_checkpoint_dir, read_table

__all__ = ["get_spark", "ensure_checkpoint_dir", "read_table"]
