"""Findings of round 3 about disk: tables of unknown size, bands of one node and small files."""

from pyspark.sql import functions as F

from docsift.llm import minhash, simhash
from docsift.llm.shared import persisted


def _many_parts(spark):
    return spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).filter("src % 10 <> 9").repartition(37)


def test_rounds_of_components_write_no_more_parts_than_their_rows_need(spark):
    """op11 on check_h: each round wrote files for every shuffle partition, however few its rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        labels = simhash.components(_many_parts(spark))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert labels.rdd.getNumPartitions() == 1
    assert {(r.node, r.label) for r in labels.collect()} == {(k, k - k % 10) for k in range(400)}


def test_components_are_the_same_when_labels_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SENT", 10)
    labels = simhash.components(_many_parts(spark))
    assert {(r.node, r.label) for r in labels.collect()} == {(k, k - k % 10) for k in range(400)}


def test_only_bands_of_several_nodes_are_kept(spark):
    """op11 on check_h: all bands of all nodes were shuffled four times."""
    words = [f"w{k * k % 997}" for k in range(300)]
    near = [*words[:150], "other", *words[151:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    nodes = persisted(minhash.marked(docs, minhash.SHINGLE).filter("size > 0"))
    posts = minhash.posted(nodes)
    want = {(k, n) for k, n in nodes.select(F.explode("bands").alias("key")).groupBy("key").count().filter("count > 1").collect()}
    got = posts.collect()
    assert want and {(r.key, r.n) for r in got} == want and len(got) == sum(n for _, n in want)
    assert all(r.band in range(minhash.BANDS) for r in got) and len({(r.key, r.band) for r in got}) == len(want)
    assert [(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3)]


def test_rows_in_no_group_are_not_shuffled(spark):
    """pipeline, simhash_near_dedup: the join with the few groups moved all rows, as a checkpoint's size isn't known."""
    docs = spark.createDataFrame([(k, f"text {k % 90} of its own {k % 90}") for k in range(100)], "doc_id long, text string")
    out = simhash.one_of_each(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(r.doc_id for r in out.collect()) == list(range(90))
