"""The pipeline stage by stage on the smallest tables, and the registered SQL."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from linkloom.llm import common, simhash
from linkloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    want, got = (x[cols].sort_values("doc_id").reset_index(drop=True) for x in (want, got))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_stages(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), "test")
        seen.append(name)
        rows = docs.collect()
        if name != "encoding":
            assert docs.columns == before.columns
        if name == "quality classifier":
            kept = {r.doc_id for r in rows}
            clean = [i for i, x in labels.items() if x.quality == 1 and x.toxic == 0]
            assert sum(i in kept for i in clean) > 0.95 * len(clean)
            assert not any(i in kept for i, x in labels.items() if x.quality == 0 and x.toxic == 1)
        if name == "exact dedup":
            own = [" ".join(r.text.split()) for r in rows]
            assert len(own) == len(set(own)) == len({" ".join(r.text.split()) for r in before.collect()})
        if name == "near dedup":
            left = {r.doc_id for r in rows}
            old = {r.doc_id: simhash.fingerprints(r.text.encode(), 5)[0] for r in before.collect()}
            for i in old.keys() - left:  # each that goes is near to one with a smaller id, or to one that is
                assert any((old[i] ^ f).bit_count() <= 20 for j, f in old.items() if j != i)
        if name == "mixing":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()}
    assert len(seen) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def _shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _first_of_near(texts):
    """The ids that stay of (id, text): the least of each component of five-word-shingle similarity >= 0.8."""
    sets = {i: _shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            same = len(sets[i] & sets[j])
            if 5 * same >= 4 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i}


def test_near_copies_at_the_threshold(spark):
    """Pairs with similarities from 0.79 to 0.87, on both sides of 0.8, and a passage that all share."""
    passage = [f"common{k}" for k in range(12)]
    texts, n = {}, 0
    for pair in range(120):
        words = [f"w{pair}x{k}" for k in range(92)] + passage
        changed = [f"y{pair}x{k}" for k in range(7 + pair % 6)]  # as many of 100 shingles differ
        texts[n], texts[n + 1] = " ".join(words), " ".join(changed + words[len(changed) :])
        n += 2
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id for r in simhash.near_copies_dropped(d).collect()}
    assert got == _first_of_near(texts) and 120 < len(got) < 240


def test_dedup_stages_by_brute_force(spark, sf_dir):
    """The ids that stay in the exact and the near stage are those of plain Python; near copies are planted besides."""
    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf_dir).select("doc_id", "text").collect()]
    top = max(i for i, _ in rows) + 1
    long = [t.split() for _, t in rows if 100 <= len(t.split()) <= 400][:40]
    for k, words in enumerate(long):
        changed = [f"new{k}x{j}" for j in range(len(words) * (6 + k % 8) // 100)]
        rows.append((top + k, " ".join(changed + words[len(changed) :])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    exact = corpus_pipeline.exact(spark, docs, sf_dir)
    first = {}
    for i, t in sorted(rows):
        first.setdefault(" ".join(t.split()), (i, t))
    left = dict(first.values())
    assert {r.doc_id for r in exact.collect()} == set(left)
    want = _first_of_near(left)
    assert {r.doc_id for r in corpus_pipeline.near(spark, common.written(exact, "test"), sf_dir).collect()} == want
    assert len(want) < len(left)


def test_near_copies_come_from_the_anchor_cover(spark, monkeypatch):
    """The cover's links are asked for, and with and without any of them the same rows stay."""
    texts = {2 * k + j: " ".join([f"w{k}x{i}" for i in range(300)] + [f"end{k}x{j}"] + ["all"] * 3) for k in range(20) for j in range(2)}
    texts[99] = texts[3].upper()  # the same set of shingles
    docs, seen, own = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), [], simhash.near_edges

    def cover(nodes, threshold):
        found = own(nodes, threshold)
        seen.append(found.count())
        return found

    monkeypatch.setattr(simhash, "near_edges", cover)
    kept = {r.doc_id for r in simhash.near_copies_dropped(docs).collect()}
    assert seen and seen[0] >= 15 and kept == _first_of_near(texts) == set(range(0, 40, 2))
    monkeypatch.setattr(simhash, "near_edges", lambda nodes, threshold: own(nodes, threshold).limit(0))
    assert {r.doc_id for r in simhash.near_copies_dropped(docs).collect()} == kept
