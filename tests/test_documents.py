"""The search index: whole batches only, whatever is interrupted, and derived statistics that follow every change."""

import pytest
from pyspark.sql import functions as F

from parley import schema
from parley.operators import indexed, search
from parley.plans.tables import scratch
from parley.sources import index


def rows(spark, path):
    return sorted((r.conv_id, r.label) for r in index.read_search_docs(spark, path).collect())


def table(spark, *pairs):
    return spark.createDataFrame(pairs, "conv_id long, label string")


def texts(spark, *given):
    return spark.createDataFrame(given, "conv_id long, idx int, owner string, content string")


SHAPE = index.Shape(buckets=4, blocks=8)


def state(spark, path):
    """All that readers can see of an index."""
    own = index.Index(spark, path, SHAPE)
    return tuple(sorted(map(tuple, df.collect())) for df in (
        own.docs().select("conv_id", "idx", "owner", "content"), own.postings(), own.frequencies(), own.sizes(),
        own.gram_terms(own.frequencies().select(F.explode(index.grams(F.col("term"), 2)).alias("gram")).distinct())))


def test_replace_and_remove(spark):
    path = scratch(spark, "docs")
    assert index.read_search_docs(spark, path) is None
    index.delete_search_docs(spark, path, table(spark, (1, "x")).select("conv_id"))
    index.write_search_docs(table(spark, (1, "a"), (1, "b"), (2, "c"), (3, "d")), path, buckets=4)
    index.write_search_docs(table(spark, (1, "new")), path, table(spark, (2, "x")).select("conv_id"), buckets=4)
    assert rows(spark, path) == [(1, "new"), (3, "d")]
    index.write_search_docs(table(spark, (2, "back"), (None, "nobody")), path, buckets=4)
    index.delete_search_docs(spark, path, table(spark, (3, "")).select("conv_id"), buckets=4)
    want = [(1, "new"), (2, "back")]
    found = index.read_search_docs(spark, path)
    assert sorted(map(tuple, found.filter("conv_id is not null").collect())) == want
    assert [r.label for r in found.filter("conv_id is null").collect()] == ["nobody"]
    index.write_search_docs(table(spark, (9, "z")), path, whole=True)
    assert rows(spark, path) == [(9, "z")]


def test_statistics_after_batches_equal_those_of_a_rebuild(spark):
    path, again = scratch(spark, "index"), scratch(spark, "index")
    index.write_batch(texts(spark, (1, 0, "o", "one two two"), (1, 3, "o", "three"), (2, 0, "p", "two four"),
                            (3, 0, "o", None), (4, 0, "o", "gone soon")), path, SHAPE)
    index.write_batch(texts(spark, (1, 0, "o", "one two five"), (5, 0, "p", "Two, two!")), path, SHAPE,
                      texts(spark, (4, 0, "", "")).select("conv_id"))
    for _ in range(2):  # a batch that comes twice changes nothing
        index.write_batch(texts(spark, (2, 0, "q", "two four")), path, SHAPE)
    live = texts(spark, (1, 0, "o", "one two five"), (2, 0, "q", "two four"), (3, 0, "o", None), (5, 0, "p", "Two, two!"))
    index.write_batch(live, again, SHAPE, whole=True)
    assert state(spark, path) == state(spark, again)
    index.copied(index.Index(spark, path, SHAPE), again)
    assert state(spark, path) == state(spark, again)
    assert index.Index(spark, again, SHAPE).batches == [2]


@pytest.mark.parametrize("table_name", ["postings", "sizes"])
def test_an_interrupted_batch_shows_nothing_and_is_repeated(spark, monkeypatch, table_name):
    path, put = scratch(spark, "index"), index._put
    index.write_batch(texts(spark, (1, 0, "o", "one two"), (2, 0, "o", "two")), path, SHAPE)
    before = state(spark, path)

    def stop(rows, place, *rest):
        if place.endswith(table_name):
            raise KeyboardInterrupt
        put(rows, place, *rest)

    change = texts(spark, (1, 0, "o", "three two two"))
    monkeypatch.setattr(index, "_put", stop)
    with pytest.raises(KeyboardInterrupt):
        index.write_batch(change, path, SHAPE)
    assert state(spark, path) == before
    monkeypatch.setattr(index, "_put", put)
    index.write_batch(change, path, SHAPE)
    assert state(spark, path)[2] == [("o", "three", 1, 1), ("o", "two", 2, 3)]


def test_a_reader_keeps_its_batches(spark):
    path = scratch(spark, "index")
    index.write_batch(texts(spark, (1, 0, "o", "one")), path, SHAPE)
    own = index.Index(spark, path, SHAPE)
    index.write_batch(texts(spark, (1, 0, "o", "two")), path, SHAPE)
    assert [r.term for r in own.postings().collect()] == ["one"]


def searched(spark):
    docs = [(c, i, f"o{c % 2}", f"alpha word{c * i % 17} beta{'b' * (i % 3)} {'gamma ' * (c % 5)}tail{c}") for c in range(60)
            for i in range(4)]
    queries = spark.createDataFrame([("q1", "o0", "gamma wor tail3"), ("q2", "o1", "beta alpha"), ("q3", "o1", "zz"),
                                     ("q4", "o0", "al")], "query_id string, owner string, text string")
    return texts(spark, *docs), queries


def test_search_equals_search_over_texts(spark):
    docs, queries = searched(spark)
    path = scratch(spark, "index")
    index.write_batch(docs.filter("conv_id < 50"), path, SHAPE)
    index.write_batch(docs.filter("conv_id >= 45").withColumn("idx", F.col("idx")), path, SHAPE, docs.filter(
        "conv_id = 7").select("conv_id"))
    live = docs.filter("conv_id <> 7")
    terms = search.postings(live, ["conv_id", "idx", "owner"])
    want = search.search(terms, live.select(index.word_count("content").alias("len")), queries, ["conv_id", "idx"], ["owner"])
    own = index.Index(spark, path, SHAPE)
    columns = ["query_id", "owner", "conv_id", "idx", "score"]
    assert sorted(map(tuple, indexed.search(own, queries).select(*columns).collect())) == sorted(
        map(tuple, want.select(*columns).collect()))
    grouped = search.group_hits(want, per_group=2, groups=5)
    for blocks in (1, 100):
        top = indexed.top_groups(own, queries, 5, 2, first_blocks=blocks)
        kept = [*columns, "group_rank"]
        assert sorted(map(tuple, top.select(*kept).collect())) == sorted(map(tuple, grouped.select(*kept).collect()))


def test_only_the_buckets_asked_for_are_read(spark):
    docs, queries = searched(spark)
    path, shape = scratch(spark, "index"), index.Shape(buckets=16)
    index.write_batch(docs, path, shape)
    own = index.Index(spark, path, shape)
    asked = spark.createDataFrame([("gamma",)], "term string")
    assert own.buckets_of(asked) == [r.bucket for r in own.frequencies().filter("term = 'gamma'").select(
        index.bucket("term", 16).alias("bucket")).distinct().collect()]
    one = queries.filter("query_id = 'q1'").withColumn("text", F.lit("gamma"))
    hits = indexed.search(own, one, wildcards=False)
    read = [line for line in hits._jdf.queryExecution().toString().splitlines()
            if "PartitionFilters" in line and "postings" in line]
    assert read and all("bucket#" in line for line in read)
    assert hits.count() > 0


def test_rebuild_replaces_the_whole_table(spark, messages):
    from parley.streaming import sync

    path = scratch(spark, "rebuild")
    msg = messages([(f"c{c}", i, {"content": f"text {c}"}) for c in range(8) for i in range(2)])
    conv = spark.createDataFrame([(f"c{c}", "o", "New", None) for c in range(8)],
                                 "conv_id string, owner string, status string, deleted timestamp")
    full = conv.withColumns({
        "user": F.lit(None).cast(schema.USER), "context": F.lit(None).cast(schema.CONTEXT),
        "last_modified": F.current_timestamp(), "properties": F.expr("cast(map() as map<string, array<string>>)")})
    sync.rebuild_docs(full, msg, path)
    gone = full.withColumn("deleted", F.when(F.col("conv_id") >= "c4", F.current_timestamp()))
    sync.rebuild_docs(gone, msg, path)
    assert {r.conv_id for r in index.read_search_docs(spark, path).collect()} == {"c0", "c1", "c2", "c3"}


def test_shortest_window_holds_all_found_terms(spark):
    import random

    from parley.functions.text import shortest_window

    rng = random.Random(7)
    cases = [([], ["a"]), (["x", "y"], ["a"]), (["q", "a"], ["a", "n"]), (["a", "b"], []), (None, ["a"]), (["a"], None),
             (["x"] * 5000 + ["b"] + ["x"] * 5000 + ["a"], ["a", "b"])]
    cases += [([rng.choice("abcdxyz") for _ in range(rng.randint(1, 30))], rng.sample("abcd", rng.randint(1, 4)))
              for _ in range(200)]

    def plain(tokens, terms):
        found = set(tokens or ()) & set(terms or ())
        places = [i for i, t in enumerate(tokens or ()) if t in found]
        ends = [(b - a, b, a) for k, a in enumerate(places) for b in places[k:k + 60] if found <= set(tokens[a:b + 1])]
        return (min(ends)[2], min(ends)[1]) if found and ends else None

    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, tokens array<string>, terms array<string>")
    got = {r.i: r.w and tuple(r.w) for r in df.select("i", shortest_window(F.col("tokens"), F.col("terms")).alias("w")).collect()}
    assert got == {i: plain(*c) for i, c in enumerate(cases)}


def test_passages_of_hits(spark):
    from parley.operators.queries import passages

    docs = spark.createDataFrame([("t", 1, "Red, green! and BLUE; then red."), ("t", 2, None), ("t", 3, "redder")],
                                 "client string, id int, text string")
    hits = docs.select(F.lit("q").alias("query_id"), "client", "id")
    queries = spark.createDataFrame([("q", "t", "red blue")], "query_id string, client string, text string")
    got = {r.id: tuple(r)[3:] for r in passages(hits, docs, queries).collect()}
    assert got == {1: (3, 5, "<em>BLUE</em> then <em>red</em>"), 2: (None,) * 3, 3: (None,) * 3}
    assert passages(hits.limit(0), docs, queries).count() == 0
