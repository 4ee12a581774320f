import os

from chronofold.cluster import clean, materialise


def test_materialised_tables_lie_in_the_shared_folder_and_go(spark):
    rows = materialise(spark.range(10), "numbers")
    (path,) = {os.path.dirname(f) for f in rows.inputFiles()}
    assert path.startswith(spark.conf.get("spark.checkpoint.dir").replace("file:///", "file:/")[:6]) and rows.count() == 10
    clean(spark)
    assert not os.path.exists("/" + path.removeprefix("file:").lstrip("/"))
