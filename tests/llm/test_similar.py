"""Near-duplicates at Jaccard 0.8 over five words, against all pairs."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from lodestone.llm import simhash, similar
from lodestone.llm.shared import perhaps, settle


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def slow_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = [d for d, _ in rows]
    moved = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in pairs:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                moved = True
    return sorted((d, c) for (d, _), c in zip(rows, least))


def test_stage_takes_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    rows = [(1, changed()), (2, changed(0)), (3, changed(30)), (4, changed(0, 59)), (5, changed(10, 20, 30, 40, 50)), (6, "Short text"), (7, "short  TEXT"), (8, "short words"), (9, None), (10, " "), (11, "w0 w1 w2 w3 w4"), (12, changed(2)), (12, "another text of this id")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, similar.similar_documents(table).collect())) == slow_components(rows)
    assert sorted(r[0] for r in corpus_pipeline.near_dedup(spark, table, "").select("doc_id").collect()) == [1, 5, 6, 8, 9, 11, 12]
    assert corpus_pipeline.near_dedup(spark, table.where("doc_id < 0"), "").count() == 0


def test_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, similar.similar_documents(table).collect()))
    assert got == slow_components(sorted(map(tuple, table.collect())))


def test_one_row_of_each_group_stays(spark):
    """Ids that repeat with other texts, rows without an id, repeated rows, names that clash."""
    a, b, c = ("a word or two of it " * 9, "some other words of it " * 9, "all else that is said " * 9)
    rows = [(2, b), (4, a), (4, b), (4, a), (None, b), (None, c), (None, c), (7, None), (8, ""), (9, a + "more")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kept_doc_id int, is_first string")
    for keep in (simhash.keep_first, similar.keep_first_similar):
        out = keep(table)
        assert out.columns == table.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert set(got) - {(9, a + "more")} == {(2, b), (4, a), (None, c), (7, None)} and len(got) == len(set(got))


def test_names_that_differ_by_case(spark):
    table = spark.createDataFrame([(1, "one text", 1, "x"), (2, "one text", 2, "y")], "doc_id long, text string, KEPT_DOC_ID int, Kept_H1 string")
    for keep in (simhash.keep_first, similar.keep_first_similar):
        assert list(map(tuple, keep(table).collect())) == [(1, "one text", 1, "x")]


def test_split_shards_lose_no_link(spark):
    """Sixty texts that share most words stand in the same shards; groups of four meet in tiles."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"v{i}" if j % 97 == i % 97 or (i % 3 and j == 150) else w for j, w in enumerate(words[: 200 - 15 * (i % 5)]))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_components(rows)
    assert sorted(map(tuple, similar.similar_documents(table, 4).collect())) == want == sorted(map(tuple, similar.similar_documents(table).collect()))
    groups = spark.createDataFrame([(i, 10, [7, 8]) for i in range(30)] + [(99, 10, [9])], "fp long, size long, keys array<long>")
    tiles = {}
    for r in similar.shards_of(groups, 4).collect():
        tiles.setdefault((r["shard"], r["tile"]), set()).add(r["fp"])
    met = {(a, b) for t in tiles.values() for a in t for b in t}
    assert met == {(a, b) for a in range(30) for b in range(30)} and len({s for s, _ in tiles}) == 1 and max(map(len, tiles.values())) < 20


def test_texts_that_match_nothing_are_not_moved(spark):
    """With joins by shuffle, as for large tables: few near copies among many texts, and each set is built once."""
    draw = random.Random(4)
    rows = [(i, " ".join(str(draw.random()) for _ in range(300))) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " more") for i in range(40)] + [(i, rows[i][1]) for i in range(5)] + [(None, rows[3][1])]
    table = settle(spark.createDataFrame(rows, "doc_id long, text string"), "test-texts")
    size = sum(len(t) for _, t in rows)
    before, was = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, similar.keep_first_similar(table).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == sorted(rows[:1500])
    moved = shuffled(spark) - before
    print("moved", moved, "of", size)
    assert moved < size / 2


def test_perhaps(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    rows = spark.range(6000)
    got = {r["id"]: r["yes"] for r in perhaps(rows, [F.col("id")], keys, [F.col("k")], "yes").collect()}
    assert len(got) == 6000 and all(got[i] for i in range(0, 3000, 3)) and sum(got.values()) < 1000 + 5000 / 8
    assert perhaps(rows, [F.col("id")], keys.where("k < 0"), [F.col("k")], "yes").where("yes").count() == 0
