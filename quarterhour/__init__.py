"""Quarter-hourly demand analytics as PySpark DataFrame, SQL and streaming operators."""

BLOCKS_PER_DAY = 96
