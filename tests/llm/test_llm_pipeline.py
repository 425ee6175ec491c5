"""The pipeline's rows against a chain of brute-force stages."""

from __future__ import annotations

import brute
import corpus_pipeline

from sitepulse.llm.storage import Scratch


def chained(tables):
    docs = [(d, x) for d, x in tables["documents"] if x and any(c.isalpha() for c in x)]
    by = {}
    for d, x in docs:  # the largest id of equal texts
        if x not in by or (d is not None and (by[x] is None or d > by[x])):
            by[x] = d
    docs = [(d, x) for x, d in by.items()]
    least, out = {}, []
    fps = [brute.fingerprint(x) for _, x in docs]
    root = brute.groups(set(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    for (d, _), f in zip(docs, fps):
        r = root[f]
        least[r] = min([v for v in (least.get(r), d) if v is not None], default=None)
    seen = set()
    for (d, x), f in zip(docs, fps):
        if d == least[root[f]] and root[f] not in seen:
            seen.add(root[f])
            out.append((d, x))
    dirty = [r[5] for r in brute.op6({"documents": out, "benchmark": tables["benchmark"]})]
    return brute.op10({"documents": [r for r, bad in zip(out, dirty) if not bad]})


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables["dir"]).collect()
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(chained(tables), key=key)
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_stages_keep_the_columns(spark, edge):
    docs = spark.read.parquet(f"{edge['dir']}/documents.parquet")
    names = docs.columns
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, edge["dir"]), name)
        assert docs.columns == names
