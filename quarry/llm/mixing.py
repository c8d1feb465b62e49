"""Mixing sources to target weights: hash-random keys, range-sorted, cut at exact budgets.

Every document gets a key from a hash of its id, so its place within its source is random
and the same in every run. Keys are split into equal ranges (hash-random, so equal ranges
hold about equally many rows, and a source with a third of all rows spreads over all of
its ranges). Token counts are summed by (source, range), a running sum over the ranges
gives each range's start, and a running sum inside each range places every document. A
source's budget then cuts its order at one exact token; budgets above one epoch repeat
whole epochs first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import as_row, map_arrow, materialize, pick, scratch, small_batches, table, text_digest, utf8

#: Rows that one key range of a source is meant to hold.
RANGE_ROWS = 20_000
#: Hex digits of the key that name its range: more ranges than any corpus needs.
RANGE_DIGITS = 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): share of all sizes by weight, no target above most x size.

    Weights repeat over the sources in code point order, null last. Sharing the excess
    again by weight until no target is above its limit ends where the capped sources are
    those with the smallest limit for their weight; so with sources in order of that
    ratio, the level at which the rest share is a running sum away.
    """
    by_code = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    picks = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("n", F.row_number().over(by_code) - 1).withColumn("weight", picks).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    # one row per source from here on: these windows see sources, not documents
    order = W.orderBy(F.col("limit") / F.col("weight"), "n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = (
        ranked.withColumn("pool", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("pool") - F.col("spent")) / F.col("left_weight"))
        .withColumn("capped", F.col("weight") * F.col("level") > F.col("limit"))
    )
    common = F.min(F.when(~F.col("capped"), F.struct("rank", "level"))).over(everything)["level"]
    final = levels.withColumn("rank", F.row_number().over(order)).withColumn("common", common)
    target = F.when(F.col("capped") | F.col("common").isNull(), F.col("limit")).otherwise(F.col("weight") * F.col("common"))
    return final.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest of the text, size of every row.

    Size is how many runs of characters other than space and U+0009 to U+000D the text has; 0 for null.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        # bytes.split() parts at the same six characters
        found = pa.array([len(x.split()) for x in utf8(batch.column(3))], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["doc_id", "source", "digest", "size"])

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="long", source="string", text="string").select("doc_id", "source", text_digest().alias("digest"), "text")
    return map_arrow(rows, count, "doc_id long, source string, digest string, size long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How many words of each document the mix takes.

    Reads doc_id, text and source; any other column is ignored. Returns one row per input
    row: doc_id, source, digest (of the text), size, source_size, target, taken. A null text
    has size 0, a null source is a source of its own, rows that repeat (also a doc_id) each
    count, a null doc_id has a key like any other. Rows of equal key follow doc_id, size,
    then digest; rows equal in these too share the cut by their order, which changes nothing
    in the result as a set. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with scratch() as keep:
        sized = keep(materialize(sizes(docs), "sizes"))  # the texts are read once; the rest works on these short rows
    ranges = _ranges(spark, sized)
    sized = sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    first = F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("long")
    sized = sized.withColumn("range", F.floor(first / F.lit(16.0**RANGE_DIGITS) * F.lit(ranges)).cast("long"))
    targets = source_targets(sized, weights, share, most)
    by_range = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    starts = by_range.withColumn("start", F.coalesce(F.sum("in_range").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.range", "start", "source_size", "target")
    inside = W.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "digest").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.range") == F.col("b.range")))
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return joined.select("a.doc_id", "a.source", "digest", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves, in the columns of documents, whatever these are named.

    A document taken whole k times gives k rows; the one at the cut gives a row with its
    first words only. Documents of which nothing is taken go. A document without words
    goes, as it can add nothing to a budget. n_chars, if there, is counted again.

    The plan's short rows meet each text once, by id, source and digest. Rows that agree in
    all three are interchangeable but for other columns: the plan says how many of them get
    how much, and their number among each other tells which.
    """
    def key() -> Column:
        """Never null, so the join and the numbering use one partitioning of the texts."""
        return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))

    same = mix(docs).groupBy(key().alias("key"), "size", "taken").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("key").orderBy("taken"))
    # rows of a key differ in at most three amounts: an epoch more, the cut, an epoch less
    shares = same.withColumn("upto", upto).groupBy("key").agg(F.first("size").alias("size"), F.max("taken").alias("most"), F.array_sort(F.collect_list(F.struct("upto", "taken"))).alias("shares"))
    rows = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_digest().alias("digest"))
    joined = rows.select("row", key().alias("key")).join(shares.filter("most > 0").drop("most"), "key")
    number = F.row_number().over(W.partitionBy("key").orderBy(F.lit(1)))
    taken = F.get(F.filter("shares", lambda s: s["upto"] >= F.col("number")), F.lit(0))["taken"]
    planned = joined.withColumn("number", number).withColumn("taken", taken).filter("taken > 0")
    epochs = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    left = F.transform(epochs, lambda i: F.least(F.col("size"), F.col("taken") - (i.cast("long") - 1) * F.col("size")))
    copies = planned.select("row", "size", F.explode(left).alias("left"))
    # pieces that end with a word each, white space in front kept
    whole = F.col("row.text")
    pieces = F.split(whole, "(?<=[^ \\t\\n\\x0B\\f\\r])(?=[ \\t\\n\\x0B\\f\\r])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("left").cast("int")), "")
    copies = copies.withColumn("text", F.when(F.col("left") >= F.col("size"), whole).otherwise(cut))
    kinds = dict(docs.dtypes)
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast(kinds.get("n_chars", "long"))}
    return copies.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


#: DuckDB: targets by the level that the uncapped sources share, then a running sum in key order.
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (
  SELECT source, sum(size) AS s, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w
  FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY 2.0 * s / w, source IS NULL, encode(source)) AS r FROM totals),
levels AS (
  SELECT *, (1.5 * CAST(sum(s) OVER () AS DOUBLE) - coalesce(sum(CAST(2.0 * s AS DOUBLE)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ranked),
common AS (SELECT min(r) AS r, arg_min(level, r) AS level FROM levels WHERE w * level <= 2.0 * s),
targets AS (
  SELECT l.source, CAST(s AS BIGINT) AS source_size,
         CAST(CASE WHEN c.r IS NULL OR l.r < c.r THEN 2.0 * s ELSE w * c.level END AS DOUBLE) AS target
  FROM levels l CROSS JOIN common c),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""


def _ranges(spark: SparkSession, sized: DataFrame) -> int:
    """Key ranges per source: enough that one holds RANGE_ROWS rows if all rows were one source's."""
    rows = sized.count()
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(at_least, -(-rows // RANGE_ROWS))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
