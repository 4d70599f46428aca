import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a query's rows with its SQL's."""
    import duckdb
    import pandas as pd

    def plain(x):
        if not hasattr(x, "__len__") and pd.isna(x):
            return None
        return round(x, 6) if isinstance(x, float) else list(map(plain, x)) if hasattr(x, "__len__") and not isinstance(x, (str, bytes)) else x

    def check(df, sql, folder):
        c = duckdb.connect()
        for p in Path(folder).iterdir():
            c.sql(f"create view {p.stem} as select * from '{p}'")
        want = c.sql(sql).df()
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        rows = lambda x: sorted(str([plain(v) for v in r]) for r in x[names].astype(object).itertuples(index=False))
        got = df.toPandas()
        for f in df.schema:  # pandas holds integers beside nulls as floats
            if f.dataType.simpleString() in ("bigint", "int"):
                got[f.name] = got[f.name].astype("Int64")
        assert rows(got) == rows(want)

    return check
