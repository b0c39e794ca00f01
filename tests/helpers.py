from datetime import datetime, timedelta

AS_OF = datetime(2024, 1, 31)
INV_SCHEMA = "parent string, name string, size bigint, mtime timestamp, is_directory boolean, seq bigint"


def inv_df(spark, rows):
    """rows: (parent, name, size, age_seconds, is_directory)"""
    data = [(p, n, s, None if a is None else AS_OF - timedelta(seconds=a), d, i)
            for i, (p, n, s, a, d) in enumerate(rows)]
    return spark.createDataFrame(data, INV_SCHEMA)
