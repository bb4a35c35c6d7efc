import inspect
from collections import Counter

import corpus_pipeline
from maskframe.llm import langid, mixing, neardup, quality
from maskframe.llm.queries import queries

from .cases import EDGES, frame, rows
from .test_neardup import brute as components
from .test_neardup import copies


def test_stages_follow_each_other(spark, tmp_path):
    data = rows(150) + copies() + EDGES
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Each stage by itself, in plain steps on the driver.
    df = frame(spark, data)
    step = [x for x in data if x[1] and any(c.isalpha() for c in x[1])]
    assert Counter(r["doc_id"] for r in langid.keep_known(df).collect()) == Counter(x[0] for x in step)
    from .test_quality import brute as stats

    good = []
    for x in step:
        n, _, _, _, again = stats(x[1])
        if n >= 10 and 100 * again <= 20 * n:
            good.append(x)
    kept = [x[0] for x in components(good, 5, 80) if x[3]]
    docs = [x for x in good if x[0] in set(kept)]
    want = Counter()
    for r in mixing.mix(frame(spark, docs)).collect():
        want[r["doc_id"]] += r["copies"]
    first = Counter(r["doc_id"] for r in out if r["piece"] == 0)
    assert first == +want


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "dedup", "mix", "pack"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
    assert neardup.TREES and quality.FIT_ROWS


def tables(spark, folder, data, labels=((1, 1, 0),), clash=False):
    frame(spark, data, clash=clash).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_runs_keep_their_rows(spark, tmp_path):
    """A second run in the same session leaves the first one's files alone; clashing columns are carried along."""
    folder = tables(spark, tmp_path, rows(60) + EDGES, clash=True)
    first = corpus_pipeline.run(spark, folder)
    second = corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(first) == key(second) != []


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0
