"""Sources with many rows and few words are many shards, and the mix stays near its targets."""

from pyspark.sql import functions as F

from barloom.llm import mixing


def test_rows_bound_a_shard(spark, monkeypatch):
    rows = [(i, "" if i % 3 else None, "blank") for i in range(900)] + [(1000 + i, "w " * (i % 7), "few") for i in range(600)] + [(2000 + i, "x y z", None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    seen, write = {}, mixing.staged

    def kept(df, name):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(mixing, "staged", kept)
    got = mixing.mix(docs, shard_rows=100, block=4).collect()
    assert {r.source: r.shards for r in seen["sources"].collect()} == {"blank": 9, "few": 6, None: 2}
    assert len(got) == len(rows) and all(r.taken == 0 for r in got if r.source == "blank") and all(r.taken <= 2 * r.size for r in got)
    for source in ("few", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4 * (6 + 2) and mine[0].source_size == sum(r.size for r in mine)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(5), shard_rows=100, block=4).collect()))
