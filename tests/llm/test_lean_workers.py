"""What Python workers keep once a task has freed its memory."""

import numpy as np
import pyarrow as pa

from cellweave.llm.jaccard_join import jaccard_components


def test_workers_give_back_what_they_free(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_components(docs).collect()} == {(1, 2, 1), (2, 2, 1)}

    def held(batches):
        def own():
            return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) / 1024

        for _ in batches:
            before = own()
            for turn in range(2):  # a block of 24 MB that is freed lets glibc keep later ones, between which small ones stay
                np.ones(3 << 20)
            some, kept = [], []
            for i in range(20):
                some.append(np.ones(1 << 20))
                kept.append(np.ones(1 << 10))
            del some
            yield pa.RecordBatch.from_arrays([pa.array([own() - before]), pa.array([pa.default_memory_pool().backend_name])], ["mb", "pool"])

    row = spark.range(1).mapInArrow(held, "mb double, pool string").first()
    assert row.pool == "system"
    assert row.mb < 20
