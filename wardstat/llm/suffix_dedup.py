"""Operator 4: substring deduplication by sparse suffix sorting.

Every byte that lies in a ``length``-byte string which also starts in a
document of smaller id is removed.  Sorting all suffixes would move
``length`` bytes for every byte of text, so the suffixes are thinned without
losing any match: every window of ``length`` bytes picks the ``GRAM``-byte
string of smallest hash inside it as its anchor.  Equal windows pick the same
anchor, wherever they stand; neighbouring windows mostly share one and form a
run, so a text has one run for about every 18 bytes.

1.  The texts are dealt into chunks of a few MB.  A chunk sends the hashes of
    its anchors, once each, with the number of distinct runs where there are
    many, and learns which of them more than one document has and which are
    hot (one bit each).
2.  For those anchors it sends the bytes of their runs, equal runs once with
    the smallest id, to the bucket of the anchor's hash.  An anchor at the
    edge of a common passage has another run in every document, since the run
    reaches into its context: the runs of an anchor that is hot (about
    ``hot_runs`` distinct ones in all) are sent window by window, equal
    windows once with the smallest id, to the buckets of the windows' hashes.
3.  A bucket sorts the suffixes that start at every window of its runs, the
    deep-shallow way: a multikey quicksort over 8-byte characters to a depth
    of 16 bytes, then blind tries for the groups that are still equal: all
    members of a group descend along one leaf at once, the place where they
    leave it (depth and byte) makes the branches, and the branches go on the
    same way.  Equal suffixes share a leaf; its smallest id decides which
    windows go.
4.  The chunk gets one bit per window back and cuts its texts.

What moves is the text once, 8 bytes per anchor, the runs of shared anchors
and the windows of hot ones.  A passage that a third of all documents share is
one run in each chunk for the anchors inside it, and for those at its edges
distinct windows spread over all buckets.  Nothing depends on the order of
rows or partitions.

Defined results: null texts are empty; texts shorter than ``length`` lose
nothing; rows that share an id do not remove from each other; null ids rank
behind all others; repeated rows are cut alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

GRAM = 16                 # bytes of an anchor
CHUNK_BYTES = 4 << 20     # text of a chunk
BLOCK = 1 << 17           # windows that are hashed at a time
SHALLOW = 16              # bytes the quicksort looks at
MANY = 16                 # runs of an anchor in a chunk from which on the distinct ones are counted
HOT_RUNS = 2048           # counted runs of an anchor from which on its windows are dealt singly
NO_ID = np.iinfo(np.int64).max


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every offset, as little-endian numbers (``buf`` must
    be padded)."""
    return np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,))


class Chunk:
    """Texts of one chunk with the runs of their windows."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, length: int):
        self.ids, self.length = ids, length
        self.start, self.end = offsets[:-1], offsets[1:]
        self.buf = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
        self.first, self.last, self.hash = self._runs(len(data))
        self.doc = np.searchsorted(self.end, self.first, "right")      # end > first: the text of the run
        self.doc_id = ids[self.doc]

    def _runs(self, n: int):
        length, none = self.length, np.empty(0, np.int64)
        mark = np.zeros(n + 1, np.int32)
        long_ones = self.end - self.start >= length
        np.add.at(mark, self.start[long_ones], 1)
        np.add.at(mark, self.end[long_ones] - length + 1, -1)
        valid = np.cumsum(mark)[:max(0, n - length + 1)] > 0
        words, grams = _words(self.buf), length - GRAM + 1
        first, last, hashes = [none], [none], [np.empty(0, np.uint64)]
        for lo in range(0, len(valid), BLOCK):
            windows = np.flatnonzero(valid[lo:lo + BLOCK])
            if not len(windows):
                continue
            m = min(BLOCK, len(valid) - lo) + grams - 1
            h = words[lo:lo + m] * np.uint64(0x9E3779B97F4A7C15)
            h ^= words[lo + 8:lo + 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            # smallest hash of a window, leftmost of equals: position in the low bits
            low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
            width = 1
            while 2 * width <= grams:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < grams:
                low = np.minimum(low[:width - grams], low[grams - width:])
            at = (low & np.uint64(0xFFFFFF)).astype(np.int64)[windows]
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)]))
            ends = np.concatenate([new[1:], [len(windows)]]) - 1
            first.append(windows[new] + lo)
            last.append(windows[ends] + lo)
            hashes.append(h[at[new]])
        return np.concatenate(first), np.concatenate(last), np.concatenate(hashes)

    def anchors(self):
        """Distinct anchor hashes, ascending, whether two ids have them, and
        the number of their distinct runs (one where there are few)."""
        order = np.argsort(self.hash, kind="stable")
        h, d = self.hash[order], self.doc_id[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        if not len(at):
            return h, np.empty(0, bool), np.empty(0, np.uint32)
        many, size = np.ones(len(at), np.uint32), np.diff(np.concatenate([at, [len(h)]]))
        if (size > MANY).any():
            raw = self.buf.tobytes()
            for k in np.flatnonzero(size > MANY).tolist():
                runs = order[at[k]:at[k] + size[k]]
                many[k] = len({raw[a:b] for a, b in zip(self.first[runs].tolist(), (self.last[runs] + self.length).tolist())})
        return h[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at), many

    def shared_runs(self, shared: np.ndarray):
        """Runs whose anchor is in ``shared`` (ascending): their indices, the
        number of the distinct run each equals, and of the distinct ones the
        bytes, smallest id and anchor hash."""
        if len(shared):
            at = np.searchsorted(shared, self.hash)
            runs = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == self.hash)
        else:
            runs = np.empty(0, np.int64)
        raw, known, number = self.buf.tobytes(), {}, np.empty(len(runs), np.int64)
        for k, (a, b) in enumerate(zip(self.first[runs].tolist(), (self.last[runs] + self.length).tolist())):
            number[k] = known.setdefault(raw[a:b], len(known))
        low = np.full(len(known), NO_ID)
        np.minimum.at(low, number, self.doc_id[runs])
        anchor = np.zeros(len(known), np.uint64)
        anchor[number] = self.hash[runs]
        return runs, number, list(known), low, anchor


class Items:
    """What a chunk sends of its distinct runs: those of hot anchors as their
    distinct windows, the others as they are.  ``parts``, their smallest
    ``ids`` and the hashes (``key``) that deal them to buckets."""

    def __init__(self, spans: list[bytes], low: np.ndarray, anchor: np.ndarray, hot: np.ndarray, length: int):
        is_hot = np.isin(anchor, hot)
        self.low, self.whole, self.split = low, np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
        known, number = {}, []
        for k in self.split.tolist():
            s = spans[k]
            number += [known.setdefault(s[j:j + length], len(known)) for j in range(len(s) - length + 1)]
        size = np.fromiter((len(spans[k]) - length + 1 for k in self.split.tolist()), np.int64, len(self.split))
        self.number, self.run = np.array(number, np.int64), np.repeat(self.split, size)
        self.place = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size)
        ids = np.full(len(known), NO_ID)
        np.minimum.at(ids, self.number, low[self.run])
        self.parts = [spans[k] for k in self.whole.tolist()] + list(known)
        self.ids = np.concatenate([low[self.whole], ids])
        self.key = np.concatenate([anchor[self.whole], _window_hash(list(known), length)])

    def masks(self, bits: np.ndarray) -> np.ndarray:
        """One bit per window of every distinct run, from the items' bits."""
        mask = np.zeros(len(self.low), np.uint64)
        n = len(self.whole)
        mask[self.whole] = bits[:n]
        goes = (bits[n:][self.number] & np.uint64(1) == 1) | (self.ids[n:][self.number] < self.low[self.run])
        np.bitwise_or.at(mask, self.run, goes.astype(np.uint64) << self.place.astype(np.uint64))
        return mask


def _window_hash(windows: list[bytes], length: int) -> np.ndarray:
    wide = -(-length // 8) * 8
    data = np.zeros((len(windows), wide), np.uint8)
    data[:, :length] = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, length)
    h = np.zeros(len(windows), np.uint64)
    for w in data.view("<u8").T:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


# --- deep-shallow sorting ---------------------------------------------------

def _refine(rank: np.ndarray, members: np.ndarray, keys: tuple) -> np.ndarray:
    """Order the members inside their groups of equal rank by ``keys`` (first
    key first); each new group gets the sorted position of its first member as
    rank.  Returns the members sorted."""
    own = rank[members]
    if len(keys) == 1:                                           # quicksort by the character, then by group where there are several
        order = np.argsort(keys[0])
        if own.size and own.min() != own.max():
            order = order[np.argsort(own[order], kind="stable")]
        order = members[order]
    else:
        order = members[np.lexsort((*[k for k in reversed(keys)], own))]
    back = np.empty(len(rank), np.int64)
    back[members] = np.arange(len(members))
    r = rank[order]
    group = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    differs = np.concatenate([[True], r[1:] != r[:-1]])
    for k in keys:
        s = k[back[order]]
        differs[1:] |= s[1:] != s[:-1]
    size = np.diff(np.concatenate([group, [len(order)]]))
    base = np.repeat(r[group] - group, size)                     # sorted position of a group minus its place here
    heads = np.flatnonzero(differs)
    place = np.repeat(heads, np.diff(np.concatenate([heads, [len(order)]])))
    rank[order] = base + place
    return order


def _tied(rank: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Members that share their rank with another one."""
    n = np.bincount(rank[members], minlength=len(rank))
    return members[n[rank[members]] > 1]


def deep_shallow_rank(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length``-byte suffix prefixes from ``starts`` in their
    sorted order; equal ones share a rank.  ``buf`` is padded by 8 bytes."""
    words = _words(buf)
    rank = np.zeros(len(starts), np.int64)
    members = np.arange(len(starts))
    depth = 0
    while depth < min(SHALLOW, length - 8) and len(members):     # multikey quicksort, 8-byte characters
        _refine(rank, members, (words[starts[members] + depth].byteswap(),))
        members = _tied(rank, members)
        depth += 8
    at = [*range(depth, length - 7, 8)]
    if not at or at[-1] != length - 8:
        at.append(length - 8)
    while len(members):                                          # blind tries
        order = members[np.argsort(rank[members], kind="stable")]
        r = rank[order]
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        leaf = np.repeat(order[head], np.diff(np.concatenate([head, [len(order)]])))
        lcp = np.full(len(order), length, np.int64)
        byte = np.zeros(len(order), np.int64)
        side = np.ones(len(order), np.int64)                     # before, on or behind the leaf's path
        open_ = np.flatnonzero(order != leaf)
        for o in at:
            x, y = words[starts[order[open_]] + o], words[starts[leaf[open_]] + o]
            bad = np.flatnonzero(x != y)
            if len(bad):
                k = open_[bad]
                diff = x[bad] ^ y[bad]
                skip = (np.log2((diff & (~diff + np.uint64(1))).astype(np.float64)).astype(np.int64)) // 8
                lcp[k] = o + skip
                byte[k] = buf[starts[order[k]] + lcp[k]]
                side[k] = np.where(byte[k] < buf[starts[leaf[k]] + lcp[k]], 0, 2)
                open_ = np.delete(open_, bad)
        # left of the path shallow branches come first, right of it deep ones
        _refine(rank, order, (side, np.where(side == 2, -lcp, lcp), byte))
        members = _tied(rank, order[side != 1])
    return rank


def shared_windows(spans: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For each run (bytes, id) one bit per window: an equal window stands in
    a run of smaller id.  Equal runs, one from each chunk that has them, are
    sorted once, with their smallest id: of the others every window goes."""
    known: dict = {}
    number = np.fromiter((known.setdefault(s, len(known)) for s in spans), np.int64, len(spans))
    owner = np.full(len(known), NO_ID)
    np.minimum.at(owner, number, ids)
    size = np.fromiter(map(len, known), np.int64, len(known)) - length + 1
    buf = np.frombuffer(b"".join(known) + b"\0" * 8, np.uint8)
    base = np.concatenate([[0], np.cumsum(size + length - 1)[:-1]])
    head = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.arange(int(size.sum())) - np.repeat(head, size)
    rank = deep_shallow_rank(buf, np.repeat(base, size) + inside, length)
    owners = np.repeat(owner, size)
    low = np.full(len(rank), NO_ID)
    np.minimum.at(low, rank, owners)
    bits = np.bitwise_or.reduceat((low[rank] < owners).astype(np.uint64) << inside.astype(np.uint64), head)
    every = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
    return np.where(ids > owner[number], every[number], bits[number])


# --- the four steps ----------------------------------------------------------

def _chunk(t: pa.Table, length: int) -> Chunk:
    t = t.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
    text = t["text"].chunk(0) if t["text"].num_chunks else pa.array([], pa.binary())
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return Chunk(t["id"].to_numpy(), offsets - offsets[0], data, length)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) % buckets


def _by_bucket(h: np.ndarray, buckets: int):
    """(bucket, indices) of the hashes, indices in their given order."""
    b = _bucket(h, buckets)
    order = np.argsort(b, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], b[order][1:] != b[order][:-1]])) if len(h) else []
    for k, part in zip(at, np.split(order, at[1:]) if len(h) else []):
        yield int(b[order[k]]), part


def _table(rows: list[tuple], names: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(names, cols)})


_SEND = [("chunk", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_SEND_DDL = "chunk long, bucket long, a binary, b binary, c binary"
_BACK = [("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int64()), ("a", pa.binary())]
_BACK_DDL = "chunk long, bucket long, kind long, a binary"


#: kinds of answers
SHARED, WINDOWS, HOT = 0, 1, 2


def _answers(back: pa.Table, kind: int) -> dict:
    return {b: a for b, k, a in zip(back["bucket"].to_pylist(), back["kind"].to_pylist(), back["a"].to_pylist()) if k == kind}


def _marked(h: np.ndarray, back: pa.Table, kind: int, buckets: int) -> np.ndarray:
    """The chunk's anchors that the bits of a kind mark (no row: none)."""
    bits = _answers(back, kind)
    keep = np.zeros(len(h), bool)
    for b, part in _by_bucket(h, buckets):
        if b in bits:
            keep[part] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(part)).astype(bool)
    return h[keep]


def _items(c: Chunk, back: pa.Table, buckets: int):
    """The runs of the chunk's shared anchors, the number of the distinct run
    of each, and the items that are sent for them."""
    h = np.unique(c.hash)
    runs, number, spans, low, anchor = c.shared_runs(_marked(h, back, SHARED, buckets))
    return runs, number, Items(spans, low, anchor, _marked(h, back, HOT, buckets), c.length)


def cut(docs: DataFrame, length: int = 50, chunk_bytes: int = CHUNK_BYTES, text: bool = False, hot_runs: int = HOT_RUNS,
        row: Column | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the
    ``kept`` bytes and the removed ``spans`` ("start:end", comma-joined).
    ``row``: a number that tells rows of equal id and text apart and is the
    same each time they are read; by it rows are dealt, without it by id and
    text."""
    if not GRAM + 8 <= length <= GRAM + 63:
        raise ValueError("a run's windows must fit into 64 bits")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                        F.xxhash64(*(["doc_id", "text"] if row is None else [row])).alias("deal"))
    dealt = dealt.select(F.pmod("deal", F.lit(n)).alias("chunk"),
                         F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")

    def send_anchors(key, t):
        h, twice, many = _chunk(t, length).anchors()
        def counted(p):
            at = np.flatnonzero(many[p] > 1)
            return np.concatenate([at.astype(np.uint32), many[p][at]]).tobytes() if len(at) else None
        return _table([(key[0].as_py(), b, h[p].tobytes(), np.packbits(twice[p]).tobytes(), counted(p))
                       for b, p in _by_bucket(h, n)], _SEND)

    def answer_anchors(key, t):
        chunks = t["chunk"].to_pylist()
        parts = [np.frombuffer(a, np.uint64) for a in t["a"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)).astype(bool) for b, p in zip(t["b"].to_pylist(), parts)]
        every = np.concatenate(parts)
        order = np.argsort(every)
        same = np.concatenate([[False], every[order][1:] == every[order][:-1], [False]])
        shared = np.empty(len(every), bool)
        shared[order] = same[1:] | same[:-1]
        shared |= np.concatenate(twice)
        at = np.cumsum([len(p) for p in parts])[:-1]
        weight = np.ones(len(every), np.int64)
        for head, raw in zip([0, *at.tolist()], t["c"].to_pylist()):
            if raw is not None:
                place, many = np.frombuffer(raw, np.uint32).reshape(2, -1)
                weight[head + place.astype(np.int64)] = many
        group = np.flatnonzero(~same[:-1])
        total = np.add.reduceat(weight[order], group) if len(group) else weight
        hot = np.empty(len(every), bool)
        hot[order] = np.repeat(total > hot_runs, np.diff(np.concatenate([group, [len(every)]])))
        b = key[0].as_py()
        return _table([(k, b, SHARED, np.packbits(s).tobytes()) for k, s in zip(chunks, np.split(shared, at))]
                      + [(k, b, HOT, np.packbits(s).tobytes()) for k, s in zip(chunks, np.split(hot, at)) if s.any()], _BACK)

    def send_runs(key, t, back):
        c = _chunk(t, length)
        items = _items(c, back, n)[2]
        spans = items.parts
        rows = [(key[0].as_py(), b, b"".join(spans[k] for k in p.tolist()),
                 np.fromiter((len(spans[k]) for k in p.tolist()), np.uint16, len(p)).tobytes(), items.ids[p].tobytes())
                for b, p in _by_bucket(items.key, n)]
        return _table(rows, _SEND)

    def answer_runs(key, t):
        spans, ids, counts = [], [], []
        for raw, sizes, low in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["c"].to_pylist()):
            ends = np.cumsum(np.frombuffer(sizes, np.uint16).astype(np.int64)).tolist()
            spans += [raw[a:b] for a, b in zip([0, *ends], ends)]
            ids.append(np.frombuffer(low, np.int64))
            counts.append(len(ends))
        bits = shared_windows(spans, np.concatenate(ids), length)
        return _table([(k, key[0].as_py(), WINDOWS, x.tobytes()) for k, x in
                       zip(t["chunk"].to_pylist(), np.split(bits, np.cumsum(counts)[:-1]))], _BACK)

    def cut_texts(key, t, back):
        c = _chunk(t, length)
        runs, number, items = _items(c, back, n)
        came, bits = _answers(back, WINDOWS), np.zeros(len(items.parts), np.uint64)
        for b, p in _by_bucket(items.key, n):
            bits[p] = np.frombuffer(came[b], np.uint64)
        mask = items.masks(bits)
        size = len(c.buf) - GRAM - 8
        mark = np.zeros(size + 1, np.int32)
        whole = c.doc_id[runs] > items.low[number]          # the same run stands in this chunk under a smaller id
        np.add.at(mark, c.first[runs[whole]], 1)
        np.add.at(mark, c.last[runs[whole]] + length, -1)
        some = runs[~whole]
        m = mask[number[~whole]]
        for k in range(length - GRAM + 1):
            at = c.first[some[(m >> np.uint64(k)) & np.uint64(1) == 1]] + k
            np.add.at(mark, at, 1)
            np.add.at(mark, at + length, -1)
        gone = np.cumsum(mark)[:size] > 0
        t = t.sort_by([("id", "ascending"), ("text", "ascending")])
        rows = []
        for i, null, a, b in zip(t["id"].to_pylist(), t["no_id"].to_pylist(), c.start.tolist(), c.end.tolist()):
            g = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            kept = c.buf[a:b][~g].tobytes()
            rows.append((None if null else i, b - a, int(g.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(),
                         *((kept, ",".join(f"{x}:{y}" for x, y in edge.reshape(-1, 2).tolist())) if text else ())))
        return _table(rows, out)

    out = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
           *([("kept", pa.binary()), ("spans", pa.string())] if text else [])]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans string" if text else "")
    chunks = dealt.groupBy("chunk")
    first = chunks.applyInArrow(send_anchors, _SEND_DDL).groupBy("bucket").applyInArrow(answer_anchors, _BACK_DDL)
    second = (chunks.cogroup(first.groupBy("chunk")).applyInArrow(send_runs, _SEND_DDL)
              .groupBy("bucket").applyInArrow(answer_runs, _BACK_DDL))
    return chunks.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(cut_texts, ddl)
