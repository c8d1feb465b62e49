"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most the sequence length. Only the histogram of piece
lengths (one count per length, whatever the corpus) reaches the driver. There lengths are
placed longest first, each into the pattern that is shortest so far, which updates counts
of patterns, not packs. Pieces then find their place by rank among pieces of their
length: ranks come from counts by (length, hash range) and a running sum, so even a
length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import map_arrow, materialize, parts_for, pick, small_batches, table, vocabulary_path

SEQUENCE = 2048
END_ID = 1
#: Pieces that one (length, range) group is meant to hold.
RANGE_ROWS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Texts of these code points only go the faster way; its results are the same there.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f]*")


class Encoder:
    """Ids by `tokenizers` from a vocabulary file; plain texts by `tiktoken` with the same ranks if given."""

    def __init__(self, vocabulary: str, ranks: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.special = {token.content: number for number, token in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=self.special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (vocabulary, ranks) not in _encoders:
        _encoders[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _encoders[vocabulary, ranks]


def cut(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut at each multiple of length.

    Null and empty texts are the end id alone; a null doc_id stays; equal rows give equal
    pieces; an empty table gives none. with_ids adds the ids themselves.
    """
    vocabulary = vocabulary_path(vocabulary)
    if ranks is None and vocabulary.endswith("byte_bpe_50k.json"):
        ranks = vocabulary_path(None, "byte_bpe_50k.tiktoken")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, out = encoder(vocabulary, ranks), defaultdict(list)
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
            for start in range(0, len(ids), length):
                piece = ids[start : start + length]
                for name, value in zip(names, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=False):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(piece.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
    small_batches(docs.sparkSession)
    return map_arrow(pick(docs, doc_id="long", text="string"), split, PIECES + ", ids array<long>" * with_ids)


def patterns(histogram: dict[int, int], length: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) by shortest-pack-first: at most a few patterns per length, whatever the counts."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # by room left
    rooms: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def add(count: int, lengths: tuple[int, ...]) -> None:
        room = length - sum(lengths)
        if not room:
            done.append((count, lengths))
            return
        if not open_packs[room]:
            heapq.heappush(rooms, -room)
        open_packs[room].append([count, lengths])

    for size in sorted(histogram, reverse=True):
        left, made = histogram[size], []
        while left:
            while rooms and not open_packs[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room < size:
                per = 1 if size > length // 2 else length // size  # as the shortest pack is the one just opened
                packs, rest = divmod(left, per)
                if packs:
                    made.append((packs, (size,) * per))
                if rest:
                    made.append((1, (size,) * rest))
                break
            count, lengths = open_packs[room].pop()
            # of packs this short, each takes as many of this size as keep it the shortest
            used = min(count, left)
            if count > used:
                open_packs[room].append([count - used, lengths])
            add(used, (*lengths, size))
            left -= used
        for pack in made:
            add(*pack)
    done += [(count, lengths) for packs in open_packs.values() for count, lengths in packs]
    return sorted(done, key=lambda x: (x[1], x[0]), reverse=True)


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(length, first rank, one past the last, first sequence, offsets in the pack) for each length of each pattern."""
    out, rank, sequence = [], defaultdict(int), 0
    for count, lengths in packs:
        at, offsets = 0, defaultdict(list)
        for size in lengths:
            offsets[size].append(at)
            at += size
        for size, places in offsets.items():
            out.append((size, rank[size], rank[size] + count * len(places), sequence, places))
            rank[size] += count * len(places)
        sequence += count
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with their rank (from 0) among those of their length, hot lengths by many tasks."""
    spark = pieces.sparkSession
    ranges = max(1, parts_for(spark, pieces.count(), RANGE_ROWS))
    keyed = pieces.withColumn("range", F.pmod(F.xxhash64("doc_id", "start"), F.lit(ranges)))
    counts = keyed.groupBy("length", "range").agg(F.count("*").alias("n"))
    starts = counts.select("length", "range", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("length", "range").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    return keyed.withColumn("inside", inside).join(starts, ["length", "range"]).withColumn("rank", F.col("first") + F.col("inside")).drop("range", "first", "inside")


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """The packed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Handles nulls, empty texts and repeated rows as `cut` does; rows that repeat are packed
    as often as they occur.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, vocabulary, ranks, length), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `length` rows at most
    rows = slots(patterns(histogram, length)) or [(0, 0, 0, 0, [0])]
    plan = spark.createDataFrame(rows, "length long, low long, high long, sequence long, places array<long>")
    # as many rows as patterns have different lengths: bounded by the sequence length, not by the corpus
    found = ranked(pieces).join(F.broadcast(plan), "length").filter("rank >= low and rank < high")
    step = (F.col("rank") - F.col("low"))
    per = F.size("places").cast("long")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(step / per)).alias("sequence_id"), F.get("places", (step % per).cast("int")).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
