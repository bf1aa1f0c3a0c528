"""The stored text index: states after adding, deleting and merging equal a new index of the same documents."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, segments, textindex
from lodestone.plans.decompose import Plan
from lodestone.sources.shared import shared_path

WORDS = "sky sea tree night für 한국 bye known fact well".split()


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, strong string, weak string")


def answers(index):
    """Scores of a match with exclusions, and of a phrase."""
    asked = [textindex.matching(index, ["sky fur", "한국"], ["tree"]), textindex.phrase(index, "Bye-bye")]
    return [sorted((r.id, round(r.score, 9)) for r in textindex.bm25(index, hits).collect()) for hits in asked]


def test_states_equal_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(segments, "PER_FILE", 300)  # several buckets, and several files in each
    monkeypatch.setattr(segments, "MOST_BUCKETS", 2)
    rng = random.Random(3)
    some = lambda ids: [(i, rng.choice(WORDS), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in ids]
    path, live = shared_path(spark, "index"), {}

    def same(index):
        again = segments.open_index(spark, path)
        assert again.number == index.number and again.n_docs == len(live)
        docs = texts(spark, list(live.values()))
        want = answers(textindex.Texts(docs))
        assert any(want[0]) and answers(again) == want
        assert {(r.id, r.dl) for r in again.docs().collect()} == {(r.id, r.dl) for r in textindex.lengths(docs).collect()}
        return again

    first = some(range(60))
    live |= {r[0]: r for r in first}
    index = same(segments.create(texts(spark, first), path))
    assert index.segments[0]["buckets"] == 2
    old = index
    more = some(range(40, 90))
    live |= {r[0]: r for r in more}
    index = same(segments.add(index, texts(spark, more)))
    for i in [*range(0, 90, 7), 1000]:
        live.pop(i, None)
    index = same(segments.delete(index, spark.range(0, 90, 7).union(spark.range(1000, 1001))))
    again = some(range(0, 14))
    live |= {r[0]: r for r in again}
    index = segments.add(index, texts(spark, again))
    # two of three segments, the tombstones of the third stay
    index = same(segments.merge(index, [s["no"] for s in index.segments[1:]]))
    assert len(index.segments) == 2 and index.state["dead"]
    index = same(segments.merge(index))
    assert len(index.segments) == 1 and not index.state["dead"]
    docs = texts(spark, list(live.values()))
    assert answers(index) == answers(segments.create(docs, shared_path(spark, "index")))
    # a state that was opened before stays readable, until it is cleaned up
    assert old.n_docs == 60 and textindex.matching(old, ["sky"]).count() > 0
    assert segments.vacuum(index) and same(index).number == index.number


def test_one_writer_at_a_time_and_versions(spark):
    path = shared_path(spark, "index")
    index = segments.create(texts(spark, [(1, "a", "b")]), path, version=3)
    segments.add(index, texts(spark, [(2, "c", None)]))
    with pytest.raises(Exception, match="(?i)exist"):
        segments.delete(index, spark.range(1, 2))
    with pytest.raises(ValueError):
        segments.open_index(spark, path, version=2)
    assert segments.open_index(spark, path, version=3).n_docs == 2


def test_maintain_keeps_few_segments(spark):
    path = shared_path(spark, "index")
    index = segments.create(texts(spark, [(0, "a0", "x")]), path)
    for i in range(1, 4):
        index = segments.maintain(segments.add(index, texts(spark, [(i, f"a{i}", "x")])), fan=2)
    assert len(index.segments) == 1 and {r.id for r in textindex.matching(index, ["x"]).collect()} == set(range(4))
    empty = segments.delete(index, spark.range(6))
    assert empty.n_docs == 0 and textindex.bm25(empty, textindex.matching(empty, ["x"])).count() == 0


def test_search_reads_no_text(spark):
    """The plan has the postings' scans only, with buckets and tokens pushed down."""
    docs = texts(spark, [(i, "src", f"word{i} night sky") for i in range(50)])
    index = segments.create(docs, shared_path(spark, "index"))
    rows = textindex.bm25(index, textindex.matching(index, ["night"], ["word3"]))
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,night)" in plan and "weak" not in plan and "ArrowEvalPython" not in plan
    files = docs.select("id", F.lit("c").alias("mc_caption"))
    got = search.composed(search.Corpus(files, {}, index), {}, Plan("night sky", keywords=["night sky", "!!!"]), 5)
    plan = got._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and got.count() == 5


def test_phrases(spark):
    docs = texts(spark, [(1, "Bye-bye", "a well-known fact"), (2, "bye", "bye now"), (3, "!!!", "known fact, well"), (4, None, None)])
    for index in (textindex.Texts(docs), segments.create(docs, shared_path(spark, "index"))):
        found = lambda w, index=index: {r.id for r in textindex.phrase(index, w).collect()}
        assert [found(w) for w in ("bye bye", "well-known fact", "known FACT", "!!!", "")] == [{1}, {1}, {1, 3}, set(), set()]
        assert textindex.matching(index, ["!!!"]).count() == 0


def test_axes_without_rows_take_no_weight(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id long, mc_caption string")
    corpus = search.Corpus(files, {"V": spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")}, texts(spark, [(1, "a", "x"), (2, "b", "y")]))
    rows, used = search.merged(search.candidates(corpus, {"V": [1.0, 0.0]}, Plan("q", keywords=["nothing"]), 5), Plan("q"))
    assert used is None and {(r.id, r.rrf, r["first"]) for r in rows.collect()} == {(1, None, 1.0), (2, None, 0.0)}
    rows, used = search.merged(search.candidates(corpus, {"V": [1.0, 0.0]}, Plan("q", keywords=["x"]), 5), Plan("q"))
    assert set(used) == {"V", "M"} and all(r.rrf for r in rows.collect())
    none, _ = search.merged(search.candidates(corpus, {}, Plan("q", keywords=["nothing"]), 5), Plan("q"))
    assert none.count() == 0


def test_the_query_gives_the_tokens(spark):
    files = spark.createDataFrame([(1, "night sky"), (2, "sea")], "id long, mc_caption string")
    corpus = search.Corpus(files, {"V": spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<double>")})
    quality = lambda **how: {r.id: r.quality for r in search.composed(corpus, {"V": [1.0, 0.0]}, Plan("(Sea) !"), 5, **how).collect()}
    assert quality() == quality(tokens=["sea"]) != quality(tokens=[]) == quality(tokens=["other"])


def test_blocks_of_many_tasks_are_joined(spark):
    """A token's documents come from eight tasks and are one block; documents are stored beside, without a folder of their own."""
    docs = texts(spark, [(i, "src", f"word{i} night sky night") for i in range(80)]).repartition(8, "id")
    index = segments.create(docs, shared_path(spark, "index"))
    rows = index._stored(index.segments[0]).where("token = 'night'").collect()
    assert len(rows) == 1 and sorted(rows[0].ids) == list(range(80)) and rows[0].ends == list(range(2, 162, 2)) and rows[0].pos == [1, 3] * 80
    assert index._stored(index.segments[0]).where(F.col("bucket") == segments.DOCS).selectExpr("sum(size(ids))", "count(token)").first() == (80, 0)


def test_a_very_frequent_token_has_many_files(monkeypatch):
    """Its blocks are dealt out to a part of the files as large as its part of the words, in one bucket."""
    import pyarrow as pa

    monkeypatch.setattr(segments, "CHUNK", 400)
    rng, to = random.Random(5), segments._Files(64, 64)
    rows = [[w for _ in range(20) for w in ("the", f"w{rng.randrange(10**6)}")] for _ in range(640)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 64)), pa.array([["x"]] * 64), pa.array(rows[i : i + 64])], ["id", "strong", "weak"]) for i in range(0, 640, 64)]
    files, found = {}, []
    for packed in to.from_texts(iter(batches)):
        for file, held in zip(packed["file"].to_pylist(), packed["blocks"], strict=True):
            for b in segments._arrived(iter([pa.RecordBatch.from_arrays([pa.array([held.as_py()])], ["blocks"])])):
                for token, ids, pos, bucket in zip(*(b.column(c).to_pylist() for c in ("token", "ids", "pos", "bucket")), strict=True):
                    if token == "the":
                        files.setdefault(bucket, set()).add(file)
                        found += ids
                        assert pos == list(range(0, 40, 2)) * len(ids)
    assert sorted(found) == list(range(640)) and len(files) == 1 and len(files.popitem()[1]) > 5
