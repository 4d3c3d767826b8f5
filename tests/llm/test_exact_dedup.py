import hashlib
from collections import Counter, defaultdict

from pixelloom.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, k0 string, keep_id int"
LOWER = {c: c + 32 for c in range(65, 91)}


def digest(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def brute(rows, earlier=None):
    """(doc_id, keep_id, group_size, kept, digest) of each row; earlier: digest -> (keep_id, size) of past batches."""
    groups, out, done = defaultdict(list), [], set()
    for d, t in rows:
        groups[digest(t)].append(d)
    for d, t in rows:
        h = digest(t)
        if earlier and h in earlier:
            out.append((d, *earlier[h], False, h))
            continue
        ids = [x for x in groups[h] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[h]), d == keep and h not in done, h))
        if out[-1][3]:
            done.add(h)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)


def listed(df):
    return sorted(map(str, map(tuple, df.collect())))


ROWS = [(1, "One text"), (5, "one TEXT"), (3, "ONE text"), (None, "one text"), (2, None), (4, ""), (None, None), (6, "İ É"), (7, "i é"), (8, "É"), (9, "é"), (10, "tie"), (10, "tie"), (None, "null id"), (None, "null id"), (11, "x" * 300_000)]


def test_one_batch(spark):
    assert listed(ed.exact_dedup(frame(spark, ROWS))) == sorted(map(str, brute(ROWS)))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digests_")]


def test_batches_and_compaction(spark):
    spark.sql("DROP TABLE IF EXISTS seen_digests")
    index = ed.DigestIndex(spark, "seen_digests", 4)
    assert listed(index.add(frame(spark, ROWS))) == sorted(map(str, brute(ROWS)))
    seen = {r[4]: (r[1], r[2]) for r in brute(ROWS)}
    more = [(20, "one text"), (21, "brand new"), (22, "Brand new"), (23, None)]
    assert listed(index.add(frame(spark, more))) == sorted(map(str, brute(more, seen)))
    seen |= {r[4]: (r[1], r[2]) for r in brute(more, seen)}
    held = listed(index.table())
    index.compact()
    assert listed(index.table()) == held and len(held) == len(seen)
    again = ed.DigestIndex(spark, "seen_digests", 4)
    assert listed(again.add(frame(spark, more))) == sorted(map(str, brute(more, seen)))
    spark.sql("DROP TABLE seen_digests")


def test_hot_digests(spark):
    rows = [(k, "hot") for k in range(3000)] + [(5000 + k, f"own {k}") for k in range(50)]
    assert listed(ed.exact_dedup(frame(spark, rows))) == sorted(map(str, brute(rows)))


def test_rows_that_stay(spark):
    docs = frame(spark, ROWS)
    kept = ed.keep_first_rows(docs, ed.exact_dedup(docs))
    assert kept.schema == docs.schema
    assert Counter((r.doc_id, digest(r.text)) for r in kept.collect()) == Counter((d, h) for d, _, _, k, h in brute(ROWS) if k)


def test_repeated_rows_that_differ_elsewhere(spark):
    docs = spark.createDataFrame([(1, "t", "b", 2), (1, "t", "a", 3), (1, "T", "c", 1)], SCHEMA)
    got = [tuple(r) for r in ed.keep_first_rows(docs, ed.exact_dedup(docs)).collect()]
    assert got == [(1, "T", "c", 1)]  # the first as JSON


def test_empty_table(spark):
    docs = frame(spark, [])
    assert ed.exact_dedup(docs).collect() == [] and ed.keep_first_rows(docs, ed.exact_dedup(docs)).collect() == []


def test_plan_runs_no_python(spark):
    plan = ed.exact_dedup(frame(spark, ROWS).select("doc_id", "text"), "plan_digests")._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE plan_digests")
    assert "SortMergeJoin" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))
