"""Removal of repeated passages by sparse suffix sorting.

A byte goes if some 50-byte string that covers it also starts in a document with a
smaller id. Sorting every suffix of a corpus would move many times its size, so only
suffixes at anchors are sorted: of the 18-byte strings in each 50-byte window the one of
least hash is an anchor, which depends on the window alone, so two documents that share a
window share an anchor in it at the same offset.

1. Texts are packed into compressed blocks, written once.
2. Anchor hashes, once per block, meet by hash range; those of one document only go.
3. Around each anchor that is left a block sees its contexts, 32 bytes to either side at
   most: the windows whose least hash it has. A block sends each distinct context once,
   with the least and the greatest doc_id that it has there; where they occur stays with
   the block, in a few bytes each. Where contexts would weigh much of what the texts do,
   hash ranges take turns, so that only one turn's contexts are under way at a time.
4. Contexts of an anchor range are suffix-sorted: multikey quicksort over 8-byte
   characters to a shallow depth, then blind tries for what is still tied. Equal contexts
   show directly which bytes go; contexts that share an anchor but differ are compared, two
   by their common extension, more by sorting their windows the same way. What returns to a
   block is, for a context, bytes and the doc_id beyond which documents lose them.
5. An anchor found in very many blocks sends its distinct windows instead, as rows that are
   aggregated by content: partial least doc_ids first, then the least of these.
6. A block resolves its own occurrences, and its texts are cut.

No step holds more than a block, or the distinct contexts of one hash range; hashes only
bring candidates together, and bytes decide.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import PARTITION_BYTES, materialize, scratch, small_batches, table

WINDOW = 50
ANCHOR = 18
SIDE = WINDOW - ANCHOR
BLOCK_BYTES = 4 << 20
#: Bytes of a sort key: anchor, right side, reversed left side, both lengths, zero padding.
ROW = 88
#: An anchor in more blocks than this sends windows instead of contexts: its contexts, one a block, would outweigh
#: a block. Windows take some 30 times the room of contexts, so lines that many documents have are no reason for them.
HOT_BLOCKS = BLOCK_BYTES // ROW
#: What the contexts of a turn may weigh, of the weight of all texts, and about what those of an anchor in a block weigh when sent.
TURN_SHARE, SENT_BYTES = 0.5, 80
#: Contexts that are always sent in one turn.
TURN_LEAST = 64 << 20
#: Windows that are sorted at once.
WINDOW_ROWS = 1 << 18
SHALLOW = 2  # 8-byte characters that multikey quicksort looks at
LAST_ID = np.iinfo(np.int64).max  # a null doc_id counts as this one, larger than any

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]  # odd 64-bit constants


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors, and every window's least hash."""
    n = len(text)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = np.lib.stride_tricks.sliding_window_view(text, 8).copy().view("<u8").ravel()
    m = n - ANCHOR + 1
    a, b, c = _MULTIPLIERS
    h = words[:m] * a
    h ^= (words[8 : 8 + m] * b) >> np.uint64(7)
    h *= a
    h ^= words[ANCHOR - 8 : ANCHOR - 8 + m] * c
    h ^= h >> np.uint64(29)
    h *= b
    h ^= h >> np.uint64(32)
    least = _sliding(h, SIDE + 1, np.minimum)
    edge = np.zeros(SIDE, np.uint64)
    widest = _sliding(np.concatenate([edge, least, edge]), SIDE + 1, np.maximum)
    at = np.flatnonzero(widest == h)
    return at, h[at], least


def _sliding(values: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """of() over every run of width values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = of(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return of(values[:-rest], values[rest:]) if rest else values


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings of equal width (a multiple of 8), and which equal the one before.

    Deep-shallow: the first SHALLOW characters of 8 bytes are sorted by multikey quicksort,
    each over the ties of the last. A group still tied becomes a blind trie: members are
    compared with its first only, and hang where they leave it, so each branch keeps just
    the character that tells it apart; a branch with several members is such a group again.
    """
    n = len(rows)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64).reshape(n, rows.shape[1] // 8)
    order = np.argsort(words[:, 0], kind="stable")
    group = _numbered(words[order, 0][:, None])
    for depth in range(1, min(SHALLOW, words.shape[1])):
        tied = _tied(group)
        sub = order[tied]
        again = np.lexsort((words[sub, depth], group[tied]))
        order[tied] = sub[again]
        group = _numbered(np.stack([group.astype(np.uint64), words[order, depth]], 1))
    # from here on `todo` are places in the order that are tied; groups are runs
    todo, same = np.flatnonzero(_tied(group)), np.zeros(n, bool)
    todo_group = group[todo]
    while len(todo):
        members = order[todo]
        first = np.concatenate([[True], todo_group[1:] != todo_group[:-1]])
        run = np.cumsum(first) - 1
        leader = members[first][run]
        leaves = np.full(len(members), words.shape[1])  # the character where a member leaves the leader
        for depth in range(words.shape[1] - 1, SHALLOW - 1, -1):
            leaves[words[members, depth] != words[leader, depth]] = depth
        equal = leaves == words.shape[1]
        at = np.minimum(leaves, words.shape[1] - 1)
        own, other = words[members, at], words[leader, at]
        side = np.where(equal, 1, np.where(own < other, 0, 2))
        level = np.where(side == 0, leaves, np.where(side == 2, -leaves, 0))
        own = np.where(equal, np.uint64(0), own)
        again = np.lexsort((own, level, side, run))
        order[todo] = members[again]
        key = np.stack([run[again].astype(np.uint64), side[again].astype(np.uint64), (level[again] + words.shape[1]).astype(np.uint64), own[again]], 1)
        branch = _numbered(key)
        settled = equal[again]
        same[todo[settled]] = np.concatenate([[False], branch[1:] == branch[:-1]])[settled]
        left = _tied(branch) & ~settled
        todo, todo_group = todo[left], branch[left]
    return order, same


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Runs of equal rows, numbered."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.cumsum(np.concatenate([[False], (keys[1:] != keys[:-1]).any(1)]))


def _tied(group: np.ndarray) -> np.ndarray:
    """Which places share their run with another."""
    if not len(group):
        return np.zeros(0, bool)
    change = np.concatenate([[True], group[1:] != group[:-1], [True]])
    return ~(change[:-1] & change[1:])


def _bytes(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for array in arrays:
        np.save(out, array, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _arrays(blob: bytes, n: int) -> list[np.ndarray]:
    data = io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))
    return [np.load(data, allow_pickle=False) for _ in range(n)]


def pack_blocks(docs: DataFrame) -> DataFrame:
    """(block, n_bytes, payload): rows of docs, all columns, in compressed Arrow blocks."""

    most = BLOCK_BYTES  # workers get it from here

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = np.array([len(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()])
            start = 0
            for i, s in enumerate(sizes.tolist()):
                size += s
                if size >= most:
                    yield _block(number, [*held, batch.slice(start, i + 1 - start)], size)
                    number, held, size, start = number + 1, [], 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield _block(number, held, size)

    small_batches(docs.sparkSession)
    return materialize(docs.mapInArrow(pack, "block long, n_bytes long, payload binary"), "blocks", "none")


def _block(number: int, batches: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    whole = pa.Table.from_batches(batches).combine_chunks()
    with pa.ipc.new_stream(sink, whole.schema) as out:
        out.write_table(whole)
    payload = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["block", "n_bytes", "payload"])


def _unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def _texts(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = np.array([LAST_ID if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)
    return ids, [np.frombuffer(x or b"", np.uint8) for x in rows.column("text").cast(pa.binary()).to_pylist()]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition sorted by its first column, a group at a time."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            first = next(iter(row.values()))
            if first != key and held:
                yield key, held
                held = []
            key = first
            held.append(row)
    if held:
        yield key, held


def _rows(names: str, kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split())


def anchor_hashes(payload: bytes) -> np.ndarray:
    """A block's anchor hashes, sorted, each once; the lowest bit says whether two of its documents have it."""
    ids, texts = _texts(_unpack(payload))
    found = [anchors(t)[1] | np.uint64(1) for t in texts]
    hashes = np.concatenate([*found, np.zeros(0, np.uint64)])
    owner = np.repeat(ids, [len(x) for x in found])
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    if not len(hashes):
        return hashes
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    ends = np.concatenate([np.flatnonzero(first)[1:], [len(hashes)]]) - 1
    several = owner[first] != owner[ends]
    return (hashes[first] & ~np.uint64(1)) | several.astype(np.uint64)


def shared_hashes(parts: list[np.ndarray], hot_blocks: int) -> list[np.ndarray]:
    """For each block's hashes, those in another block or several documents; the lowest bit: in more than hot_blocks."""
    every = np.concatenate(parts)
    plain = every & ~np.uint64(1)
    order = np.argsort(plain, kind="stable")
    ordered = plain[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    number = np.cumsum(first) - 1
    count = np.bincount(number)
    several = np.bincount(number, weights=(every[order] & np.uint64(1)).astype(float)) > 0
    keep = np.empty(len(every), bool)
    keep[order] = ((count > 1) | several)[number]
    hot = np.empty(len(every), bool)
    hot[order] = (count > hot_blocks)[number]
    out, at = [], 0
    for part in parts:
        mine = slice(at, at + len(part))
        out.append((plain[mine] | hot[mine].astype(np.uint64))[keep[mine]])
        at += len(part)
    return out


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _extremes(of: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest id of each of n things."""
    low, high = np.full(n, LAST_ID), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, of, ids)
    np.maximum.at(high, of, ids)
    return low, high


def contexts(payload: bytes, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct contexts, their anchors' hashes, their least and greatest doc_ids, and (context, document, place) of each anchor."""
    ids, texts = _texts(_unpack(payload))
    known = np.sort(shared[(shared & np.uint64(1)) == 0])
    rows, keys, found = [np.zeros((0, ROW), np.uint8)], [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
    for k, text in enumerate(texts):
        at, full, least = anchors(text)
        chosen = _among(full & ~np.uint64(1), known)
        p, h = at[chosen], full[chosen]
        if not len(p):
            continue
        padded = np.concatenate([np.zeros(SIDE, np.uint8), text, np.zeros(SIDE, np.uint8)])
        _, own = _windows_of(p, h, least)
        left, right = SIDE - own.argmax(1), SIDE - own[:, ::-1].argmax(1)
        around = np.lib.stride_tricks.sliding_window_view(padded, 2 * SIDE + ANCHOR)[p]
        row = np.zeros((len(p), ROW), np.uint8)
        row[:, :WINDOW] = around[:, SIDE:]
        row[:, WINDOW : WINDOW + SIDE] = around[:, SIDE - 1 :: -1]
        reach = np.arange(SIDE)
        row[:, ANCHOR:WINDOW][reach >= right[:, None]] = 0
        row[:, WINDOW : WINDOW + SIDE][reach >= left[:, None]] = 0
        row[:, WINDOW + SIDE], row[:, WINDOW + SIDE + 1] = left, right
        rows.append(row)
        keys.append(h & ~np.uint64(1))
        found.append(np.stack([np.full(len(p), k), p], 1))
    row, key, place = np.concatenate(rows), np.concatenate(keys), np.concatenate(found)
    order, same = suffix_order(row)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(~same) - 1
    once = order[~same]
    return row[once], key[once], *_extremes(kind, ids[place[:, 0]], len(once)), np.concatenate([kind[:, None], place], 1)


def hot_windows(payload: bytes, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct windows around anchors of very many blocks, their least and greatest doc_ids, and where they are.

    Windows are numbered as they first appear, so places are few runs (window, document,
    place, length) of windows that follow each other.
    """
    ids, texts = _texts(_unpack(payload))
    known = np.sort(shared[(shared & np.uint64(1)) == 1] & ~np.uint64(1))
    rows, found = [np.zeros((0, WINDOW + 6), np.uint8)], [np.zeros((0, 2), np.int64)]
    for k, text in enumerate(texts):
        at, full, least = anchors(text)
        chosen = _among(full & ~np.uint64(1), known)
        if not chosen.any():
            continue
        w, own = _windows_of(at[chosen], full[chosen], least)
        w = np.unique(w[own])
        row = np.zeros((len(w), WINDOW + 6), np.uint8)
        row[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(text, WINDOW)[w]
        rows.append(row)
        found.append(np.stack([np.full(len(w), k), w], 1))
    row, place = np.concatenate(rows), np.concatenate(found)
    order, same = suffix_order(row)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(~same) - 1
    first, _ = _extremes(kind, np.arange(len(kind)), int((~same).sum()))
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    window = number[kind]
    fresh = np.concatenate([[True], (window[1:] != window[:-1] + 1) | (place[1:, 0] != place[:-1, 0]) | (place[1:, 1] != place[:-1, 1] + 1)])[: len(window)]
    starts = np.flatnonzero(fresh)
    length = np.diff(np.append(starts, len(window)))
    return row[np.sort(first), :WINDOW], *_extremes(window, ids[place[:, 0]], len(first)), np.concatenate([window[starts, None], place[starts], length[:, None]], 1)


def _windows_of(at: np.ndarray, hashes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows around each anchor, and which have its hash as their least: a run of them."""
    w = at[:, None] + np.arange(-SIDE, 1)
    inside = np.clip(w, 0, len(least) - 1)
    return w, (w == inside) & (least[inside] == hashes[:, None])


def removals(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(row, start, end, doc_id): bytes, counted from the anchor's start, that documents beyond this doc_id lose.

    rows: contexts of a hash range as blocks sent them, each with its least and greatest
    doc_id there. A run may be part of another.
    """
    order, same = suffix_order(rows)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(~same) - 1
    content = rows[order[~same]]  # distinct, in suffix order
    least, _ = _extremes(kind, low, len(content))
    left, right = content[:, WINDOW + SIDE].astype(np.int64), content[:, WINDOW + SIDE + 1].astype(np.int64)
    whole = np.flatnonzero((high > least[kind]) & (left + right >= SIDE)[kind])
    out = [np.stack([whole, -left[kind[whole]], ANCHOR + right[kind[whole]], least[kind[whole]]], 1)]
    # contexts that share an anchor but differ
    words = np.ascontiguousarray(content[:, :24]).view(">u8").astype(np.uint64).reshape(len(content), 3)
    group = _numbered(np.stack([words[:, 0], words[:, 1], words[:, 2] >> np.uint64(48)], 1))
    size = np.bincount(group, minlength=1)[group] if len(group) else group
    by_kind = np.argsort(kind, kind="stable")
    firsts = np.searchsorted(kind[by_kind], np.arange(len(content) + 1))

    def for_rows(kinds: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> None:
        """What kinds lose, for each row of a kind that has a later document."""
        counts = firsts[kinds + 1] - firsts[kinds]
        index = np.repeat(np.arange(len(kinds)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        row = by_kind[firsts[kinds][index] + offset]
        later = high[row] > doc[index]
        row, index = row[later], index[later]
        out.append(np.stack([row, start[index], end[index], doc[index]], 1))

    pair = np.flatnonzero(size == 2)[::2]
    if len(pair):
        to_right, to_left = _common(content[pair], content[pair + 1])
        good = to_right + to_left >= SIDE
        pair, to_right, to_left = pair[good], to_right[good], to_left[good]
        for a, b in ((pair, pair + 1), (pair + 1, pair)):
            for_rows(a, -to_left, ANCHOR + to_right, least[b])
    many = np.flatnonzero(size > 2)
    cuts = np.flatnonzero(np.diff(group[many]) != 0) + 1 if len(many) else []
    held: list[np.ndarray] = []
    for part in [*np.split(many, cuts), None]:
        if part is not None and len(part):
            held.append(part)
        if held and (part is None or sum(map(len, held)) >= 8192):
            kinds = np.concatenate(held)
            of, start, end, doc = _by_windows(content[kinds], group[kinds], least[kinds])
            for_rows(kinds[of], start, end, doc)
            held = []
    return np.concatenate(out)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that two contexts of an anchor share to its right and to its left."""

    def run(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        differ = x != y
        return np.minimum(np.where(differ.any(1), differ.argmax(1), x.shape[1]), most)

    lengths = np.minimum(a[:, WINDOW + SIDE : WINDOW + SIDE + 2], b[:, WINDOW + SIDE : WINDOW + SIDE + 2]).astype(np.int64)
    return run(a[:, ANCHOR:WINDOW], b[:, ANCHOR:WINDOW], lengths[:, 1]), run(a[:, WINDOW : WINDOW + SIDE], b[:, WINDOW : WINDOW + SIDE], lengths[:, 0])


def _by_windows(content: np.ndarray, group: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end, doc_id) for contexts of anchors with several: each window's least document, by sorting the windows."""
    left, right = content[:, WINDOW + SIDE].astype(np.int64), content[:, WINDOW + SIDE + 1].astype(np.int64)
    whole = np.concatenate([content[:, WINDOW : WINDOW + SIDE][:, ::-1], content[:, :WINDOW]], 1)
    earliest = np.full((len(content), SIDE + 1), LAST_ID)
    slab = max(1, WINDOW_ROWS // len(content))
    for first in range(0, SIDE + 1, slab):
        # column j: the window that starts SIDE - j bytes before the anchor
        columns = np.arange(first, min(first + slab, SIDE + 1))
        owner, shift = np.nonzero((SIDE - columns <= left[:, None]) & (columns <= right[:, None]))
        shift = columns[shift]
        if not len(owner):
            continue
        rows = np.zeros((len(owner), 8 + WINDOW + 6), np.uint8)
        rows[:, :8] = (group[owner] * (SIDE + 1) + shift).astype(">u8")[:, None].view(np.uint8)
        rows[:, 8 : 8 + WINDOW] = np.lib.stride_tricks.sliding_window_view(whole, WINDOW, axis=1)[owner, shift]
        order, same = suffix_order(rows)
        low = np.minimum.reduceat(least[owner[order]], np.flatnonzero(~same))
        earliest[owner[order], shift[order]] = low[np.cumsum(~same) - 1]
    # windows of one context that follow each other and have the same least document are one run
    edge, change = np.ones((len(content), 1), bool), earliest[:, 1:] != earliest[:, :-1]
    there = earliest < LAST_ID
    of, first = np.nonzero(np.concatenate([edge, change], 1) & there)
    _, last = np.nonzero(np.concatenate([change, edge], 1) & there)
    return of, first - SIDE, last - SIDE + WINDOW, earliest[of, first]


class Cuts:
    """Which bytes of a block's texts go."""

    AT_ONCE = 1 << 20  # occurrences

    def __init__(self, ids: np.ndarray, sizes: list[int]) -> None:
        self.ids = ids
        self.offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])  # a place after each text, where nothing goes
        self.delta = np.zeros(int(self.offsets[-1]) + 1, np.int32)

    def _gone(self, document: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(self.delta, self.offsets[document] + start, 1)
        np.add.at(self.delta, self.offsets[document] + end, -1)

    def contexts(self, found: np.ndarray, lost: np.ndarray) -> None:
        """found: (context, document, place); lost: (context, start, end, doc_id)."""
        found = found[np.argsort(found[:, 0], kind="stable")]
        first = np.searchsorted(found[:, 0], lost[:, 0])
        counts = np.searchsorted(found[:, 0], lost[:, 0], "right") - first
        for some in _slices(counts, self.AT_ONCE):
            index = np.repeat(np.arange(some.start, some.stop), counts[some])
            at = found[first[index] + _ramps(counts[some])]
            later = self.ids[at[:, 1]] > lost[index, 3]
            at, index = at[later], index[later]
            self._gone(at[:, 1], at[:, 2] + lost[index, 1], at[:, 2] + lost[index, 2])

    def windows(self, runs: np.ndarray, lost: np.ndarray) -> None:
        """runs: (window, document, place, length); lost: (window, doc_id)."""
        earliest = np.full(int((runs[:, 0] + runs[:, 3]).max(initial=0)), LAST_ID)
        earliest[lost[:, 0]] = lost[:, 1]
        for some in _slices(runs[:, 3], self.AT_ONCE):
            index = np.repeat(np.arange(some.start, some.stop), runs[some, 3])
            step = _ramps(runs[some, 3])
            later = self.ids[runs[index, 1]] > earliest[runs[index, 0] + step]
            index, step = index[later], step[later]
            place = runs[index, 2] + step
            self._gone(runs[index, 1], place, place + WINDOW)

    def kept(self) -> Iterator[tuple[np.ndarray, int, int]]:
        """For each text: which bytes stay, how many go, in how many runs."""
        gone = np.cumsum(self.delta) > 0
        for a, b in zip(self.offsets[:-1].tolist(), (self.offsets[1:] - 1).tolist(), strict=True):
            own = gone[a:b]
            yield ~own, int(own.sum()), int((own & ~np.concatenate([[False], own[:-1]])[: len(own)]).sum())


def _slices(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches whose counts add up to about `most`, a single one beyond it included."""
    whole = np.cumsum(counts)
    start = 0
    while start < len(counts):
        before = whole[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(whole, before + most, "right")))
        yield slice(start, stop)
        start = stop


def _ramps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _meet(blocks: DataFrame, said: DataFrame, parts: int) -> DataFrame:
    """Each block with what was said of it (block, kind, data), blocks first."""
    both = blocks.selectExpr("block", f"{BLOCK} as kind", "payload as data").unionByName(said.select("block", "kind", "data"))
    return both.repartition(parts, "block").sortWithinPartitions("block", "kind")


#: Kinds of rows that meet a block: itself, hashes it shares, where its contexts are, what these lose; the same of windows.
#: Those of a later turn are as many times KINDS higher.
BLOCK, SHARED, PLACES, LOST, WINDOW_PLACES, WINDOWS_LOST = range(KINDS := 6)
_SAID = "block long, kind int, data binary"


def _said(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return _rows("block kind data", [pa.int64(), pa.int32(), pa.binary()], rows)


def _narrow(values: np.ndarray) -> np.ndarray:
    """values in 32 bits where they fit."""
    return values.astype(np.int32) if not len(values) or abs(values).max() < 1 << 31 else values


def _pack_places(found: np.ndarray) -> bytes:
    """(context, document, place) of a block, in text order: documents and places as steps."""
    steps = np.diff(found[:, 1:], axis=0, prepend=np.zeros((1, 2), np.int64))
    return _bytes(_narrow(found[:, 0]), _narrow(steps[:, 0]), _narrow(steps[:, 1]))


def _unpack_places(data: bytes) -> np.ndarray:
    kind, *steps = _arrays(data, 3)
    return np.stack([kind.astype(np.int64), *(np.cumsum(x, dtype=np.int64) for x in steps)], 1)


def turns(shared_bytes: int, text_bytes: int) -> int:
    """In how many turns contexts are sent, from the bytes of all blocks' shared hashes, 8 each, and of all texts."""
    return max(1, math.ceil(shared_bytes / 8 * SENT_BYTES / max(TURN_SHARE * text_bytes, TURN_LEAST)))


def dedup(docs: DataFrame, with_rows: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_rows: the rows themselves, cut.

    Null texts are empty: nothing is removed, and the digest is that of no bytes. A null
    doc_id counts as larger than any. Rows with equal doc_id never remove from each other,
    as neither is smaller. Texts under 50 bytes are never cut. An empty table gives no
    rows. with_rows returns the columns of docs; of a character that is removed in part,
    the rest goes too, a text that is removed whole becomes empty, and n_chars, if there,
    is counted again.
    """
    with scratch() as keep:
        return keep(_dedup(docs, with_rows))


def _dedup(docs: DataFrame, with_rows: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    wanted = docs if with_rows else docs.select("doc_id", "text")
    blocks = pack_blocks(wanted)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    buckets, hot_blocks = 4 * parts, HOT_BLOCKS

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            for row in rows:
                got = anchor_hashes(row["payload"])
                if len(got):
                    yield _rows("bucket block data", [pa.int64(), pa.int64(), pa.binary()], [(b, row["block"], got[part].tobytes()) for b, part in _by_bucket(_bucket(got, buckets))])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            got = shared_hashes([np.frombuffer(r["data"], np.uint64) for r in rows], hot_blocks)
            if out := [(r["block"], SHARED, g.tobytes(), bool((g & np.uint64(1)).any()), r["bucket"]) for r, g in zip(rows, got, strict=True) if len(g)]:
                yield _rows("block kind data hot bucket", [pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int64()], out)

    by_range = blocks.select("block", "payload").mapInArrow(hashes, "bucket long, block long, data binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    common = materialize(by_range.mapInArrow(shared, f"{_SAID}, hot boolean, bucket long"), "shared", "none")
    n_turns = turns(common.agg(F.sum(F.octet_length("data"))).first()[0] or 0, total)

    def runs_of(turn: int) -> DataFrame:
        """Where the contexts of a turn's hash ranges are, and what these lose."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Distinct contexts to their hash range; places pass that step by, under a key of their own."""
            for block, rows in _groups(batches):
                if len(rows) > 1:
                    row, key, low, high, found = contexts(rows[0]["data"], np.concatenate([np.frombuffer(r["data"], np.uint64) for r in rows[1:]]))
                    if len(row):
                        out = [(b, block, SHARED, _bytes(row[part], _narrow(part), low[part], high[part])) for b, part in _by_bucket(_bucket(key, buckets))]
                        yield _rows("bucket block kind data", [pa.int64(), pa.int64(), pa.int32(), pa.binary()], [*out, (-1 - block, block, PLACES + KINDS * turn, _pack_places(found))])

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _groups(batches):
                if bucket < 0:
                    yield _said([(r["block"], r["kind"], r["data"]) for r in rows])
                    continue
                parts_ = [_arrays(r["data"], 4) for r in rows]
                sender = np.repeat(np.arange(len(rows)), [len(x[0]) for x in parts_])
                context = np.concatenate([x[1] for x in parts_])
                lost = removals(*(np.concatenate([x[i] for x in parts_]) for i in (0, 2, 3)))
                lost = lost[np.argsort(sender[lost[:, 0]], kind="stable")]
                edges = np.searchsorted(sender[lost[:, 0]], np.arange(len(rows) + 1))
                out = []
                for i, r in enumerate(rows):
                    own = lost[edges[i] : edges[i + 1]]
                    if len(own):
                        out.append((r["block"], LOST + KINDS * turn, _bytes(_narrow(context[own[:, 0]]), own[:, 1].astype(np.int16), own[:, 2].astype(np.int16), own[:, 3])))
                if out:
                    yield _said(out)

        some = common if n_turns == 1 else common.filter(F.col("bucket") % n_turns == turn)
        sent = _meet(blocks, some, parts).mapInArrow(send, "bucket long, block long, kind int, data binary")
        sorted_ = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, _SAID)
        return materialize(sorted_, "runs", "none")  # what it shuffled goes before the next turn starts

    runs = reduce(DataFrame.unionByName, [runs_of(turn) for turn in range(n_turns)])
    if not common.filter("hot").isEmpty():
        runs = runs.unionByName(_hot_runs(blocks, common.filter("hot"), parts))

    figures = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = wanted.schema if with_rows else figures

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            whole = _unpack(rows[0]["data"])
            keys, texts = _texts(whole)
            cuts, by_kind = Cuts(keys, [len(t) for t in texts]), defaultdict(list)
            for r in rows:
                by_kind[r["kind"]].append(r["data"])
            for turn in range(n_turns):
                if data := by_kind[LOST + KINDS * turn]:
                    lost = np.concatenate([np.stack([x.astype(np.int64) for x in _arrays(d, 4)], 1) for d in data])
                    cuts.contexts(_unpack_places(by_kind[PLACES + KINDS * turn][0]), lost)
            if by_kind[WINDOWS_LOST]:
                lost = np.concatenate([np.stack(_arrays(d, 2), 1) for d in by_kind[WINDOWS_LOST]])
                cuts.windows(_arrays(by_kind[WINDOW_PLACES][0], 1)[0], lost)
            ids, out = whole.column("doc_id").to_pylist(), []
            for k, (text, (keep, gone, n)) in enumerate(zip(texts, cuts.kept(), strict=True)):
                kept = text[keep].tobytes() if gone else text.tobytes()
                out.append(kept.decode("utf-8", "ignore") if with_rows else (ids[k], len(text), gone, n, hashlib.sha256(kept).hexdigest()))
            if with_rows:
                old = whole.column("text").to_pylist()
                whole = whole.set_column(whole.schema.get_field_index("text"), "text", pa.array([None if o is None else x for o, x in zip(old, out, strict=True)], pa.string()))
                if "n_chars" in whole.schema.names:
                    i = whole.schema.get_field_index("n_chars")
                    whole = whole.set_column(i, "n_chars", pa.array([len(x) for x in out]).cast(whole.schema.field(i).type))
                yield from whole.to_batches(max_chunksize=128)
            else:
                yield _rows("doc_id n_bytes n_removed n_spans kept_sha256", [*[pa.int64()] * 4, pa.string()], out)

    return materialize(_meet(blocks, runs, parts).mapInArrow(cut, schema), "cut")


def _hot_runs(blocks: DataFrame, common: DataFrame, parts: int) -> DataFrame:
    """(block, kind, data): where windows of anchors in very many blocks are, and beyond which doc_id they go."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches):
            if len(rows) > 1:
                window, low, high, runs = hot_windows(rows[0]["data"], np.concatenate([np.frombuffer(r["data"], np.uint64) for r in rows[1:]]))
                for a in range(0, len(window), 4096):
                    some = [w.tobytes() for w in window[a : a + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(np.arange(a, a + len(some))), pa.array(some, pa.binary()), pa.array(low[a : a + 4096]), pa.array(high[a : a + 4096]), pa.nulls(len(some), pa.binary())], names=names)
                if len(window):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([_bytes(np.asfortranarray(runs))], pa.binary())], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches):
            yield _said([(block, WINDOWS_LOST, _bytes(np.array([r["number"] for r in rows]), np.array([r["least"] for r in rows])))])

    names = ["block", "number", "window", "low", "high", "data"]
    hot = materialize(_meet(blocks, common, parts).mapInArrow(send, "block long, number long, window binary, low long, high long, data binary"), "windows", "none")
    windows = hot.filter("window is not null")
    least = windows.groupBy("window").agg(F.min("low").alias("least"))
    lost = windows.join(least, "window").filter("least < high").select("block", "number", "least")
    places = hot.filter("data is not null").select("block", F.lit(WINDOW_PLACES).alias("kind"), "data")
    return places.unionByName(lost.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(packed, _SAID))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


#: DuckDB: every window as hex text, judged by the least doc_id that has it.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, o, length(x) // 2 - 49 - o AS n, substr(x, 2 * o + 1, 2 * (512 + 49)) AS y
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49, 512)) AS o FROM d WHERE length(x) >= 100)),
w AS (SELECT doc_id, o + q AS p, substr(y, 2 * q + 1, 100) AS s FROM (SELECT doc_id, o, y, unnest(range(0, least(n, 512))) AS q FROM b)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT w.doc_id, w.p FROM w JOIN m USING (s) WHERE m.least < w.doc_id),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone)),
spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b, lag(max(p) + 50, 1, 0) OVER (PARTITION BY doc_id ORDER BY r) AS before FROM runs GROUP BY doc_id, r),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
  string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY r) AS head FROM spans JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN x ELSE head || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
