"""Near-duplicate documents by an LSH forest over MinHash signatures.

Texts with equal shingle sets are one node from the start. Every node is in several
sorted orders, one per tree: by the hash of the tree's first signature values (its
region), then by the others, starting at the tree's own. Neighbours in an order are
candidates first: a region is followed deeper, value by value, until what shares the
longer prefix is small. Whatever a region still has apart is then compared, by a signature
estimate, with the rest of the region. A region too large to be held, or cut by a
partition, becomes one candidate group as a whole, so no pair that shares a region is lost.

Candidate links are joined into groups, and a group's texts meet once: an inverted index
over full shingle sets finds all exact links in it. Groups larger than a cell are split:
its cells share the group's most typical members. What these leave apart meets others by
prefix filter: linked sets share one of their rarest shingles (rare among a few sampled
members, then by hash; any one order is exact), so a text goes only to cells that have a
holder of such a shingle, and never to a cell twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import as_row, map_arrow, materialize, parts_for, pick, released, scratch, small_batches, table, text_digest, utf8

SHINGLE = 5
#: Documents are linked at 100 * intersection >= similarity * union: op7's contract, and the pipeline's stage.
LINK, STAGE_LINK = 85, 80
REGION_DEPTH = 3
#: Trees of a similarity, and the least agreeing signature values of a candidate pair. A pair right at
#: 0.85 misses them with odds of about 8 in a million, one right at 0.8 with odds of 1.4 in a million.
FORESTS = {LINK: (16, 29), STAGE_LINK: (20, 32)}
VALUES = REGION_DEPTH * max(trees for trees, _ in FORESTS.values())
#: A part of a region of more nodes is followed deeper.
REGION = 64
HELD = 4096  # nodes of a region that are compared; a larger region is a candidate group as a whole
CELL = 256
#: Members of a split group whose shingles tell which are rare in it.
SAMPLED = 32
#: Short rows in a file of a table of nodes or links, and how many files such a table may have however short it is.
FILE_ROWS, FILES = 100_000, 32

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_RADIX_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MASKS = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_ODDS = _random.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA9B0B2E4D4B2F0D)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2^64, n of each at least."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_RADIX, _RADIX_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case: differences of one running sum over all bytes."""
    data = np.frombuffer(text.lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted; of all its words as one if they are fewer."""
    words = word_hashes(text)
    size = min(SHINGLE, len(words))
    if not size:
        return words
    count = len(words) - size + 1
    h = np.full(count, size, np.uint64)
    for k in range(size):
        h = _mixed(h * np.uint64(0x2545F4914F6CDD1D) + words[k : k + count])
    return np.unique(h)


def signature(shingles: np.ndarray, size: int = VALUES) -> np.ndarray:
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[a : a + 4096, None] ^ _MASKS[:size]) * _ODDS[:size]).min(0))
    return _mixed(least)


def node_of(shingles: np.ndarray) -> int:
    """The node of all texts with this set: a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def sketches(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, digest, n_shingles, node, regions, values for each row; no node where there are no words."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, nodes, regions, values = [], [], [], []
        for text in utf8(batch.column(2)):
            own = shingle_set(text)
            sizes.append(len(own))
            if not len(own):
                nodes.append(None), regions.append(None), values.append(None)
                continue
            least = signature(own, REGION_DEPTH * trees)
            folded = np.zeros(trees, np.uint64)
            for k in range(REGION_DEPTH):
                folded = _mixed(folded * np.uint64(0x2545F4914F6CDD1D) + least[k::REGION_DEPTH])
            nodes.append(node_of(own))
            regions.append(folded.astype(">u8").tobytes())
            values.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip((sizes, nodes, regions, values), kinds, strict=True))], names=["doc_id", "digest", "n_shingles", "node", "regions", "values"])

    small_batches(docs.sparkSession)
    texts = pick(docs, doc_id="long", text="string").select("doc_id", text_digest().alias("digest"), "text")
    return map_arrow(texts, sketch, "doc_id long, digest string, n_shingles long, node long, regions binary, values binary")


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names=_EDGE)


_EDGE = ["a", "b", "tree", "region"]


class _Links:
    """Joins what is linked; says which links did join something."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def region_links(nodes: np.ndarray, values: np.ndarray, agree: int, small: int) -> list[tuple[int, int]]:
    """Links that join what agrees in a region; values: the others in the tree's order, sorted.

    Parts of more than `small` nodes are followed deeper.
    """
    links, out, need = _Links(len(nodes)), [], agree - REGION_DEPTH

    def offer(rows: np.ndarray, to: np.ndarray) -> None:
        alike = (values[rows][:, None, :] == values[to][None, :, :]).sum(2) >= need
        for i, j in zip(*np.nonzero(alike), strict=True):
            a, b = int(rows[i]), int(to[j])
            if a != b and links.join(a, b):
                out.append((int(nodes[a]), int(nodes[b])))

    todo = [(0, len(nodes), 0)]
    while todo:
        low, high, depth = todo.pop()
        span = np.arange(low, high)
        if high - low <= small:
            offer(span, span)
        elif depth == values.shape[1]:
            offer(span[:1], span)  # all values agree
        else:
            cuts = [low, *(np.flatnonzero(values[low + 1 : high, depth] != values[low : high - 1, depth]) + low + 1).tolist(), high]
            todo += [(a, b, depth + 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    if len(nodes) > small:
        # each node with those after it that are still apart from it
        root = np.array([links.root(i) for i in range(len(nodes))])
        for i in range(len(nodes)):
            rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            if not len(rest):
                if (root == root[0]).all():
                    break
                continue
            for j in rest[(values[rest] == values[i]).sum(1) >= need].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((int(nodes[i]), int(nodes[j])))
    return out


def forest_links(classes: DataFrame, nodes: int, trees: int, agree: int) -> DataFrame:
    """(a, b): candidate links from all sorted orders."""
    spark = classes.sparkSession
    parts = parts_for(spark, nodes * trees, 200_000)
    small, most = REGION, HELD  # workers get them from here

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, orders, keys = [], [], []
        for node, regions, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for t in range(trees):
                at = REGION_DEPTH * t
                nodes.append(node)
                orders.append(t)
                keys.append(regions[8 * t : 8 * t + 8] + values[at + REGION_DEPTH :] + values[:at])
        return pa.RecordBatch.from_arrays([pa.array(orders, pa.int32()), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64())], names=["tree", "key", "node"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each region; the partition's first and last may go on elsewhere, so a node of each is marked."""
        held, region, first, whole = [], None, None, True

        def link(closed: bool) -> pa.RecordBatch | None:
            """Links of what is held; closed: the region is here from start to end."""
            if len(held) < 2 and not whole:
                return None  # as most regions are
            nodes = [n for n, _ in held]
            if closed and not whole:
                values = np.frombuffer(b"".join(k for _, k in held), np.uint8).reshape(len(held), -1)
                found = region_links(np.array(nodes), values, agree, small)
                return _edges(*map(list, zip(*found, strict=True))) if found else None
            others = [n for n in nodes if n != first]
            return _edges([first] * len(others), others) if others else None

        def mark() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.nulls(1, pa.int64()), pa.array([region[0]], pa.int32()), pa.array([region[1]], pa.binary())], names=_EDGE)

        for batch in batches:
            for tree, key, node in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (tree, key[:8]) != region:
                    if region is not None:
                        if (found := link(True)) is not None:
                            yield found
                        whole = False
                    held, first = [], node
                    fresh, region = region is None, (tree, key[:8])
                    if fresh:
                        yield mark()
                elif len(held) >= most:
                    whole = True
                    if (found := link(False)) is not None:
                        yield found
                    held = []
                held.append((node, key[8:]))
        if region is not None:
            if (found := link(False)) is not None:
                yield found
            yield mark()

    schema = "a long, b long, tree int, region binary"
    small_batches(spark)
    placed = map_arrow(classes.select("node", "regions", "values"), place, "tree int, key binary, node long")
    in_order = placed.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = materialize(in_order.mapInArrow(walk, schema), "links")
    ends = found.filter("tree is not null").select("tree", "region", F.col("a").alias("node"))
    across = ends.join(ends.groupBy("tree", "region").agg(F.min("node").alias("least")), ["tree", "region"]).filter("node != least")
    return found.filter("b is not null").select("a", "b").unionByName(across.select(F.col("least").alias("a"), F.col("node").alias("b")))


def _short(df: DataFrame, rows: int, label: str) -> DataFrame:
    """df, of about so many short rows, written as files of FILE_ROWS rather than one for each shuffle partition."""
    return materialize(df.coalesce(max(FILES, -(-rows // FILE_ROWS))), label)


def components(links: DataFrame, nodes: int) -> DataFrame:
    """(node, label) of every linked node, of so many at most: equal labels where links lead. Contracts links round by round."""
    pairs = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    left = _short(links.filter("a != b").select(*pairs("a", "b")).distinct(), nodes, "contract")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least("a", F.min("b")).alias("up"))
        twice = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.a")).select("x.a", "y.up")
        hooks = _short(twice, nodes, "hooks")
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("up").alias("label"))
        else:
            labels = labels.join(hooks, labels["label"] == hooks["a"], "left").select("node", F.coalesce("up", "label").alias("label"))
        one = left.join(hooks, "a").select(F.col("up").alias("x"), "b")
        two = one.join(hooks.withColumnRenamed("a", "b"), "b").select("x", F.col("up").alias("y")).filter("x != y")
        done, left = left, _short(two.select(*pairs("x", "y")).distinct(), nodes, "contract")
        released(done)
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return _short(labels, nodes, "labels")


class Index:
    """Full shingle sets of a cell; the exact links of any set to them."""

    def __init__(self, sets: list[np.ndarray], similarity: int) -> None:
        self.similarity = similarity
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.keys, self.starts = np.unique(every[order], return_index=True)
        self.starts = np.append(self.starts, len(every))

    def linked(self, own: np.ndarray) -> np.ndarray:
        """Which members are linked with the set."""
        if not len(own) or not len(self.keys):
            return np.zeros(len(self.sizes), bool)
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == own]
        counts = self.starts[at + 1] - self.starts[at]
        where = np.arange(counts.sum()) + np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts)
        common = np.bincount(self.owner[where], minlength=len(self.sizes))
        return (100 * common >= self.similarity * (self.sizes + len(own) - common)) & (common > 0)


def cell_components(sets: list[np.ndarray], similarity: int) -> np.ndarray:
    """The smallest member that exact links lead to, for each member."""
    index, root = Index(sets, similarity), np.full(len(sets), -1)
    for start in range(len(sets)):
        if root[start] < 0:
            root[start], todo = start, [start]
            while todo:
                fresh = np.flatnonzero(index.linked(sets[todo.pop()]) & (root < 0))
                root[fresh] = start
                todo += fresh.tolist()
    return root


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows of a sorted partition, a cell at a time; a cell is what agrees in the first columns."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row.values())[:keys]
            if own != key and held:
                yield held
                held = []
            key = own
            held.append(row)
    if held:
        yield held


def _texts_of(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of each member by doc, the id of a document of the node: all texts are shuffled once, for this."""
    texts = pick(docs, doc_id="long", text="string").withColumnRenamed("doc_id", "doc")
    # by shuffle whatever the members' number, so that cost grows with the corpus
    return materialize(members.select("doc", "node").hint("merge").join(texts, "doc").select("node", "text").distinct(), "texts")


def _with_texts(members: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """members with their node's texts: several, where an id stands for several."""
    return members.select(*columns, "node").join(texts, "node").select(*columns, "node", "text")


def _resolve(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """(node, root) in each cell."""
    for rows in _cells(batches, 2):
        nodes, sets = [], []
        for row in rows:
            own = shingle_set((row["text"] or "").encode())
            if node_of(own) == row["node"]:  # an id may stand for other texts too
                nodes.append(row["node"])
                sets.append(own)
        if nodes:
            root = cell_components(sets, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[r] for r in root], pa.int64())], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Links between classes in a cell: each row that is apart with every row of another class."""
    for rows in _cells(batches, 3):
        sets, fit = [], []
        for row in rows:
            own = shingle_set((row["text"] or "").encode())
            if node_of(own) == row["node"]:
                fit.append(row)
                sets.append(own)
        member = [i for i, r in enumerate(fit) if not r["apart"]]
        index, out = Index([sets[i] for i in member], similarity), set()
        classes = np.array([fit[i]["class"] for i in member], np.int64)
        for i, row in enumerate(fit):
            if row["apart"] and member:
                near = np.unique(classes[index.linked(sets[i])])
                out |= {(row["class"], int(c)) for c in near if c != row["class"]}
        if out:
            a, b = zip(*sorted(out), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _prefixes(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """(label, shingle, node) for the rarest shingles of each member of a cell, of which linked sets share one."""
    for rows in _cells(batches, 2):
        sets = {r["node"]: own for r in rows if node_of(own := shingle_set((r["text"] or "").encode())) == r["node"]}
        sampled = sorted({r["node"] for r in rows if r["sampled"] and r["node"] in sets})
        known, counts = np.unique(np.concatenate([*(sets[n] for n in sampled), np.zeros(0, np.uint64)]), return_counts=True)
        shingles, holders = [], []
        for node in sorted({r["node"] for r in rows if not r["sampled"] and r["node"] in sets}):
            own = sets[node]
            often = np.zeros(len(own), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                often = np.where(known[at] == own, counts[at], 0)
            shingles.append(own[np.lexsort((own, often))][: len(own) + 1 - -(-similarity * len(own) // 100)].view(np.int64))
            holders.append(np.full(len(shingles[-1]), node))
        if holders:
            found = np.concatenate(holders)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rows[0]["label"])), pa.array(np.concatenate(shingles)), pa.array(found)], names=["label", "shingle", "node"])


def exact_components(classes: DataFrame, nodes: int, groups: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """(node, label) by exact links within candidate groups."""
    spark = docs.sparkSession
    members = _short(groups.join(classes, "node").select("label", "node", "doc", "values"), nodes, "members")
    n_members = members.count()
    counts = _short(members.groupBy("label").agg(F.count("*").alias("n")), n_members, "counts")
    parts = parts_for(spark, n_members, 4096)
    big = counts.filter(F.col("n") > CELL).withColumn("cells", F.ceil(F.col("n") / CELL).cast("int"))
    any_big = not big.isEmpty()
    small_batches(spark)
    few = members.join(counts.filter(F.col("n") <= CELL).select("label"), "label").withColumn("cell", F.lit(0)).withColumn("cells", F.lit(0))
    if any_big:
        many = materialize(members.join(big.select("label", "cells"), "label").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")), "many")
        # the most typical: those whose signature values are most often met in their group
        split = many.select("label", "node", F.posexplode(F.split(F.regexp_replace(F.hex("values"), "(..)", "$1 "), " ")).alias("k", "value")).filter("value != ''")
        met = split.groupBy("label", "k", "value").agg(F.count("*").alias("met"))
        scores = split.join(met, ["label", "k", "value"]).groupBy("label", "node").agg(F.sum("met").alias("typical"))
        leaders = many.join(_top(scores), ["label", "node"], "left_semi").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        few = few.unionByName(many).unionByName(leaders).distinct()
    every = _texts_of(members, docs)
    texts = _with_texts(few, every, "label", "cell").repartition(parts, "label", "cell").sortWithinPartitions("label", "cell", "node")
    found = materialize(texts.mapInArrow(lambda b: _resolve(b, similarity), "a long, b long"), "resolved")
    labels = found.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if not any_big:
        return labels
    # a node of a split group may be in several cells, and what they say is joined
    in_big = many.select("node").distinct()
    said = found.join(in_big, found["a"] == in_big["node"], "left_semi")
    joined = components(said, n_members)
    classes_now = many.join(joined.withColumnRenamed("label", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    classes_now = materialize(classes_now, "classes_now")
    more = _links_apart(classes_now, every, similarity, parts)
    final = components(more, n_members)
    merged = classes_now.join(final.withColumnRenamed("node", "class").withColumnRenamed("label", "last"), "class", "left").select("node", F.coalesce("last", "class").alias("label"))
    return labels.join(in_big, "node", "left_anti").unionByName(merged)


def _links_apart(members: DataFrame, every: DataFrame, similarity: int, parts: int) -> DataFrame:
    """(a, b): links between classes of split groups, for all nodes outside their group's largest class.

    members: label, node, doc, cell, cells, class. Who is apart has a row of the group's grid,
    everyone a column; where the two hold a rare shingle in common, both go to that cell.
    """
    per_class = members.groupBy("label", "class").agg(F.count("*").alias("n"))
    main = per_class.groupBy("label").agg(F.max(F.struct("n", "class"))["class"].alias("main"))
    marked = members.join(main, "label").withColumn("apart", F.col("class") != F.col("main"))
    n_apart = marked.filter("apart").groupBy("label").agg(F.ceil(F.count("*") / CELL).cast("int").alias("rows"))
    # groups that are all one class by now need no more
    placed = materialize(marked.join(n_apart, "label").withColumn("row", F.pmod(F.xxhash64("node", F.lit(3)), F.col("rows")).cast("int")).select("label", "node", "doc", "cell", "cells", "class", "apart", "row"), "placed")
    if placed.isEmpty():
        return placed.select(F.col("node").alias("a"), F.col("class").alias("b")).limit(0)
    by_hash = W.partitionBy("label").orderBy(F.xxhash64("node", F.lit(5)), "node")
    # some of each group, cut before the shuffle
    sampled = placed.filter("apart").select("label", "node", "doc", "cells").withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= SAMPLED).drop("n")
    sampled = sampled.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("sampled", F.lit(True))
    columns = ["label", "cell", "sampled", "node", "doc"]
    asked = placed.withColumn("sampled", F.lit(False)).select(columns).unionByName(sampled.select(columns))
    texts = _with_texts(asked, every, "label", "cell", "sampled").repartition(parts, "label", "cell").sortWithinPartitions("label", "cell", "node")
    rare = texts.mapInArrow(lambda b: _prefixes(b, similarity), "label long, shingle long, node long")
    holders = materialize(rare.join(placed.drop("label", "cells"), "node"), "holders")
    shared = holders.groupBy("label", "shingle").agg(F.collect_set(F.when(F.col("apart"), F.col("row"))).alias("rows"), F.collect_set("cell").alias("columns"), F.min("class").alias("low"), F.max("class").alias("high"))
    met = holders.join(shared.filter("size(rows) > 0 and low != high"), ["label", "shingle"])
    columns = ["label", "cell", "row", "apart", "class", "node", "doc"]
    looking = met.filter("apart").withColumn("cell", F.explode("columns")).select(columns)
    looked_at = met.withColumn("row", F.explode("rows")).withColumn("apart", F.lit(False)).select(columns)
    pairs = looking.unionByName(looked_at).distinct()
    texts = _with_texts(pairs, every, "label", "cell", "row", "apart", "class").repartition(parts, "label", "cell", "row").sortWithinPartitions("label", "cell", "row", "apart", "node")
    return materialize(texts.mapInArrow(lambda b: _compare(b, similarity), "a long, b long"), "compared")


def _top(scores: DataFrame) -> DataFrame:
    """The two best nodes of each group, by partial maxima; never a group in one task."""
    scores = materialize(scores, "scores")
    best = lambda df: df.groupBy("label").agg(F.max(F.struct("typical", "node"))["node"].alias("node"))
    first = materialize(best(scores), "leader")
    rest = scores.join(first, ["label", "node"], "left_anti")
    return first.unionByName(materialize(best(rest), "leader"))


def near_duplicates(docs: DataFrame, similarity: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Links documents from this similarity on, in hundredths: one of FORESTS. Reads doc_id and
    text only. Null and empty texts, and texts of blanks, have no shingles and are linked
    with nothing. A row with a null doc_id takes no part: it has
    no component and is kept. Rows that repeat are linked like other equal texts; where
    rows share a doc_id but not a text, each has its own links. Texts are taken whole.
    An empty table gives no rows.
    """
    with scratch() as keep:
        return keep(materialize(_traced(docs, similarity).select("doc_id", "n_shingles", "component_id", "kept"), "components"))


def _traced(docs: DataFrame, similarity: int) -> DataFrame:
    """near_duplicates with each row's digest and label; equal labels where links lead, null without shingles."""
    trees, agree = FORESTS[similarity]
    rows = materialize(sketches(docs, trees), "sketches")
    known = rows.filter("node is not null and doc_id is not null")
    classes = materialize(known.groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("regions").alias("regions"), F.first("values").alias("values")), "classes")
    nodes = classes.count()
    groups = components(forest_links(classes, nodes, trees, agree), nodes)
    labels = exact_components(classes, nodes, groups, docs, similarity)
    # roots: the smallest doc_id of each label; nodes without candidates are their own
    own = classes.join(labels, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
    own = _short(own, nodes, "own")
    least = own.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_node = _short(own.join(least, "label").select("node", "label", "component_id"), nodes, "of_node")
    out = rows.join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "digest", "n_shingles", "label", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, similarity: int = LINK) -> DataFrame:
    """The rows whose document is its component's smallest, all columns.

    Of rows with an id, those of equal texts and those that links join are one; rows that
    share an id only all stay.
    """
    with scratch() as keep:
        kept = _traced(docs, similarity).filter("kept and doc_id is not null")
        chosen = kept.groupBy("doc_id", F.coalesce(F.col("label").cast("string"), "digest").alias("group")).agg(F.min("digest").alias("digest")).select("doc_id", "digest")
        chosen = keep(materialize(chosen, "chosen"))
    rows = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))
    once = W.partitionBy("doc_id", "digest").orderBy(F.lit(1))
    found = rows.filter("doc_id is not null").join(chosen, ["doc_id", "digest"], "left_semi").withColumn("number", F.row_number().over(once)).filter("number = 1")
    return found.unionByName(rows.filter("doc_id is null"), allowMissingColumns=True).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB: all pairs that share a shingle, linked on full sets; components by recursion.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN link l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
