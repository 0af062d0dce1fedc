"""Scans of rows with long arrays decode few rows at once."""

from cellweave.llm.delta_links import delta_links
from cellweave.llm.shared import cut

KEY = "spark.sql.parquet.columnarReaderBatchSize"


def test_rounds_of_families_scan_few_rows_at_once(spark, monkeypatch):
    seen, write = {}, type(spark.range(0).write).parquet

    def noted(self, path, *args, **more):
        seen[path.rsplit("/", 1)[-1].split("-")[0]] = int(spark.conf.get(KEY))
        return write(self, path, *args, **more)

    monkeypatch.setattr(type(spark.range(0).write), "parquet", noted)
    before = spark.conf.get(KEY)
    sets = [(1, w, w, w, 10, list(range(9)) + [100 + w // 2]) for w in range(6)]
    links = delta_links(cut(spark.createDataFrame(sets, "fam long, w long, id long, c long, s long, xs array<long>")), 90)
    assert links.count() > 0
    assert all(seen[name] <= 256 for name in ("apart", "first", "links", "level"))
    assert spark.conf.get(KEY) == before
