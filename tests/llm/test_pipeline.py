import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from quarry.llm import mixing, neardup, packing, toxicity
from quarry.llm.common import materialize
from quarry.llm.queries import ORACLES, QUERIES

from .test_operators import brute_components, brute_removed, labelled, passages


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_stages_match_brute_force(spark, tmp_path):
    docs, labels = labelled(spark)
    more = [(d + 1000, t) for d, t in passages(8) if d is not None and d < 60]
    more += [(2000, more[3][1]), (2001, more[3][1].upper())]
    rows = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = rows.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    here, now, seen = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, materialize(stage(spark, now, here), name)
        seen[name] = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()], now.collect()
        if name != "packing":
            assert now.columns == rows.columns

    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    given, kept = seen["toxicity"]
    assert {r["doc_id"] for r in kept} == {d for d, t in given if model.score(t) < toxicity.THRESHOLD} and 0 < len(kept) < len(given)
    given, kept = seen["near_duplicates"]
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d, (_, _, k) in brute_components(given).items() if k) and len(kept) < len(given)
    given, kept = seen["repeated_passages"]
    want = {d: n - gone for d, n, gone, _, _ in brute_removed(given)}
    assert len(kept) == len(given) and all(want[r["doc_id"]] - 8 * 4 <= len(r["text"].encode()) <= want[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in kept)
    given, kept = seen["mixing"]
    plan = mixing.mix(spark.createDataFrame([(d, t, f"s{d % 4}") for d, t in given], "doc_id long, text string, source string")).collect()
    words = Counter()
    for r in kept:
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({r["doc_id"]: r["taken"] for r in plan if r["taken"]})
    given, packed = seen["packing"]
    encode, want = packing.Encoder(packing.vocabulary_path(None), None), Counter()
    for d, t in given:
        ids = np.append(encode(t), np.uint32(1)).astype("<u4")
        for a in range(0, len(ids), packing.SEQUENCE):
            want[d, a, zlib.crc32(ids[a : a + packing.SEQUENCE].tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed) == want


def test_stage_links_from_four_fifths(spark, tmp_path):
    """Pairs from 0.8 on lose one document in the stage, those below none; op7 links from 0.85 on."""
    rng, rows, want = random.Random(80), [], {}
    for k in range(60):
        words, n = [f"w{rng.randrange(50_000)}" for _ in range(104)], rng.randint(8, 15)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-n], *(f"x{rng.randrange(50_000)}" for _ in range(n))]))]
        want[2 * k + 1] = (100 - n) / (100 + n)  # n of 100 shingles differ
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for near, gone in ((0.8, dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path))), (0.85, neardup.keep_one(docs))):
        lost = {d for d, _ in rows} - {r["doc_id"] for r in gone.collect()}
        assert lost == {d for d, s in want.items() if s >= near} and 0 < len(lost) < len(want)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, tmp_path, odd, none, empty):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, and no rows at all, through all stages."""
    clashing = ("row", "digest", "number", "group", "taken", "left", "copy", "plan_size", "shares", "kept_id", "text_digest", "payload", "kind")
    docs = (none if empty else odd).withColumns({n: F.lit(n) for n in clashing})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), name)
        seen[name] = now.count()
        if name != "packing":
            assert now.columns == docs.columns
            if not empty:
                assert now.select(*clashing).distinct().collect() == [clashing]
    if empty:
        assert set(seen.values()) == {0}
    else:
        assert seen["toxicity"] == 10 and seen["near_duplicates"] == 8 and seen["repeated_passages"] == 8 and seen["packing"] >= seen["mixing"] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"]
