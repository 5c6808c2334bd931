import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from quarry.sources.session import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def empty_tables(tmp_path_factory):
    """All tables without rows."""
    import pyarrow.parquet as pq

    place = tmp_path_factory.mktemp("empty")
    for f in os.listdir(SMALL):
        pq.write_table(pq.read_table(f"{SMALL}/{f}").slice(0, 0), place / f)
    return str(place)


@pytest.fixture(scope="session")
def hostile_tables(tmp_path_factory):
    """The small tables with nulls in every column, repeated rows, a very long text and extra columns of clashing names."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    place = tmp_path_factory.mktemp("hostile")
    for f in os.listdir(SMALL):
        t = pq.read_table(f"{SMALL}/{f}").slice(0, 400)
        if f.split(".")[0] in ("chunks", "file_hashes", "symbol_lookup", "refs", "queries", "search_rows", "documents", "repos"):
            cols = {}
            for i, name in enumerate(t.column_names):
                v = t[name].to_pylist()
                blank = [None if k % 41 == i else x for k, x in enumerate(v)]
                if name in ("content", "text") and blank:
                    blank[0], blank[1], blank[2] = "", "word_%d " * 60_000, " \n\t"
                cols[name] = pa.array(blank, t.schema.field(name).type)
            if f.startswith("documents"):
                cols["doc_id"] = t["doc_id"]
            t = pa.table(cols)
            t = pa.concat_tables([t, t.slice(0, 20)]) if not f.startswith("documents") else t
            for extra in ("key", "value", "rank", "n", "group", "item", "word", "label", "score_", "parts", "d1", "rep", "_salt", "grp"):
                if extra not in t.column_names:
                    t = t.append_column(extra, pa.array(["x"] * t.num_rows))
        pq.write_table(t, place / f)
    return str(place)
