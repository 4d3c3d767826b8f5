import duckdb
import numpy as np

import corpus_pipeline
from pixelloom.llm import quality
from tests.llm import test_decontaminate, test_near_dup

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if stage is not corpus_pipeline.packed:
            assert docs.columns == before.columns
        docs = corpus_pipeline.materialise(docs, "t")
        steps.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    # quality: what the model scores, one by one
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {d: float(model.score(np.array([quality.features((r.text or "").encode())]))[0]) for d, r in rows.items()}
    assert steps[0] == sorted(d for d, s in scores.items() if s >= quality.THRESHOLD)
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    assert np.mean([(scores[d] >= quality.THRESHOLD) == (q == 1) for d, q in labels if d in scores]) > 0.9
    # exact copies
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for d in steps[0]:
        last[low(rows[d].text)] = max(d, last.get(low(rows[d].text), d))
    assert steps[1] == sorted(last.values())
    # near copies
    left = [(d, rows[d].text) for d in steps[1]]
    judged = test_near_dup.brute(left, 5, 80, 100)
    assert steps[2] == sorted(d for _, d, n, c in judged if n == 0 or d == c)
    # passages of the benchmark
    tests = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    verdicts = test_decontaminate.brute([(d, rows[d].text) for d in steps[2]], tests, 13)
    assert steps[3] == sorted(v[0] for v in verdicts if v[2] == 0)  # whatever its share of the text, a passage of the benchmark goes
    assert len(steps[2]) > len(steps[3])
    # every document is packed whole
    assert sorted(set(steps[4])) == steps[3]


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, empty texts and columns of clashing names; then no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, score_ double, __score int, __sum int, key0 string, tkey string, kept boolean, `a.b` int"
    rows = [(None, None), (None, "some words here"), (1, ""), (2, "tie text " * 30), (2, "tie text " * 30), (3, None), (4, "x" * 50_000)]
    for table in (rows, []):
        path = str(tmp_path / f"t{len(table)}")
        spark.createDataFrame([(d, t, "en", None, None, 0.1, 0.2, 1, 2, "k", "x", False, 3) for d, t in table], schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.materialise(stage(spark, docs, path), "odd")
            assert after.schema == docs.schema and sorted(map(str, after.collect())) == sorted({str(r) for r in after.collect()} if stage is not corpus_pipeline.quality_classifier else map(str, after.collect()))
            assert all((r.score_, r["__score"], r["__sum"], r.key0, r["a.b"]) == (0.2, 1, 2, "k", 3) for r in after.collect())
            docs = after
        got = corpus_pipeline.run(spark, path).collect()
        # the null and empty texts are one text, of which the largest doc_id stays
        assert sorted(str(r.doc_id) for r in got if r.piece == 0) == (["2", "3", "4", "None"] if table else [])
