import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from casewright.llm import sharding


def jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), *range(300)]
    frame = spark.createDataFrame([(i,) for i in ids], "k long")
    for shards in (1, 2, 24, 1000):
        got = frame.select("k", sharding.jump_hash(F.col("k"), shards).alias("p")).collect()
        for r in got:
            key = r["k"] & (1 << 64) - 1
            assert r["p"]["shard"] == jump(key, shards) and r["p"]["grown"] == jump(key, shards + 1)


def test_rows_edges_and_slots(spark, documents, edges):
    rows = sharding.assign(documents(edges), shards=3).collect()
    assert len(rows) == len(edges)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in edges)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        shards[r["doc_id"]].add(r["shard"])
        assert r["grown_shard"] in (r["shard"], 3)
        if r["doc_id"] is not None:
            assert r["shard"] == jump(xxhash.xxh64(struct.pack("<q", r["doc_id"]), seed=42).intdigest(), 3)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert sharding.assign(documents([])).count() == 0


def test_written_shards_hold_whole_rows(spark, documents, edges, tmp_path):
    frame = documents(edges)
    sharding.write_shards(frame, str(tmp_path / "out"), shards=3, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("_shard").exceptAll(frame).count() == 0 and back.count() == len(edges)
