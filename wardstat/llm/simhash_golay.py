"""Operator 2: SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's fingerprint is the 64-bit majority of the XXH64 hashes of its word
shingles.  Fingerprints that differ in at most 3 bits are linked:

* the 64 bits are cut into three segments (22, 21, 21 bits).  Of 3 errors
  spread over three segments, the two segments other than the worst hold at
  most one error each (pigeonhole), so one of the three segment pairs always
  has at most one error in either segment;
* a segment is read as a word of the perfect binary Golay code [23, 12, 7],
  which decodes every word to the one codeword within distance 3.  The keys
  of a segment are the codewords that it and its one-bit neighbours decode
  to: one key when it lies within distance 2, six when at distance 3;
* one side of the join offers, for each segment pair, all its key pairs, the
  other only the codewords it decodes to itself.  Two segments at distance
  one meet for certain: the neighbour's codeword is among the keys.  Hits are
  verified by the bit distance inside the join, and a link is accepted only
  at its first suitable segment pair, so it comes out once.

The join runs over distinct fingerprints, so a group of copies is one row,
and fingerprints that many documents share are never paired.  Components
are built from the links by star contraction (``components``).  All joins
are by shuffle, so the driver holds no rows.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; texts shorter than a shingle hash their whole word sequence;
repeated ids keep their rows and share the smallest id; null ids are never a
component id unless nothing else is in the component; an empty table gives an
empty result.  Extra columns pass through where named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from .common import by_key, join_totals
from .components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))      # (lowest bit, width)
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b110001110101                    # x^11+x^10+x^6+x^5+x^4+x^2+1 of the Golay code
MAX_KEYS = 6                                  # most keys of one segment
SIMHASH_BITS = 3                              # distance that the segment pairs guarantee


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Majority bits of the shingles' XXH64, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        h = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    v = np.array(h, np.uint64)
    counts = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ``keep`` and the fingerprint ``fp`` (signed long); map-only."""
    keep = list(keep or [])
    src = docs.select("doc_id", *keep, F.col("text").alias("_text"))

    def run(batches):
        for b in batches:
            texts = b["_text"]
            out = np.empty(b.num_rows, np.int64)
            for at in range(0, b.num_rows, 256):
                for k, t in enumerate(texts.slice(at, 256).to_pylist(), at):
                    out[k] = fingerprint(t, shingle)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[b[c] for c in keep], pa.array(out)],
                                             names=["doc_id", *keep, "fp"])

    return src.mapInArrow(run, T.StructType([src.schema["doc_id"], *[src.schema[c] for c in keep],
                                             T.StructField("fp", T.LongType())]))


# --- Golay code ------------------------------------------------------------

def _syndrome_of(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables():
    """Syndromes of the three bytes of a word, and the error that each of the
    2048 syndromes stands for (weight at most 3: the code is perfect)."""
    unit = [_syndrome_of(1 << i) for i in range(23)]
    by_byte = np.zeros((3, 256), np.int32)
    for k in range(3):
        for value in range(256):
            s = 0
            for i in range(8):
                if value >> i & 1 and 8 * k + i < 23:
                    s ^= unit[8 * k + i]
            by_byte[k, value] = s
    error = np.zeros(2048, np.int32)
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for m in range(j):
                error[unit[i] ^ unit[j] ^ unit[m]] = 1 << i | 1 << j | 1 << m
    return np.array(unit, np.int32), by_byte, error


def decode(word: np.ndarray, flip: np.ndarray, tables) -> np.ndarray:
    """Index (12 message bits) of the codeword that ``word ^ flip`` decodes
    to; ``flip`` holds 0 or single bits and broadcasts against ``word``."""
    _, by_byte, error = tables
    w = word ^ flip
    s = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16]
    return (w ^ error[s]) >> 11


def segment_keys(fp: np.ndarray, tables):
    """For each segment: own codeword index (n,) and the distinct keys
    (n, MAX_KEYS) padded with -1."""
    own, keys = [], []
    u = fp.view(np.uint64)
    for low, width in SEGMENTS:
        word = ((u >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int32)
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int32)
        all_ = decode(word[:, None], flips[None, :], tables)
        own.append(all_[:, 0].copy())
        all_.sort(axis=1)
        all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
        keys.append(-np.sort(-all_, axis=1)[:, :MAX_KEYS])
    return own, keys


def _pack(pair: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.int64(pair) << 24 | a.astype(np.int64) << 12 | b.astype(np.int64)


def _key_rows(probe: bool):
    def run(batches):
        tables = golay_tables()
        for b in batches:
            all_fp = b["fp"].to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fp), 4096):
                fp = np.ascontiguousarray(all_fp[at:at + 4096])
                own, keys = segment_keys(fp, tables)
                for p, (i, j) in enumerate(PAIRS):
                    if probe:
                        a, c = keys[i][:, :, None], keys[j][:, None, :]
                        ok = (a >= 0) & (c >= 0)
                        key = _pack(p, np.broadcast_to(a, ok.shape)[ok], np.broadcast_to(c, ok.shape)[ok])
                        of = np.broadcast_to(fp[:, None, None], ok.shape)[ok]
                    else:
                        key, of = _pack(p, own[i], own[j]), fp
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of)], names=["key", "fp"])
    return run


def links(distinct_fp: DataFrame, max_bits: int = SIMHASH_BITS) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints at most ``max_bits`` apart
    (up to 3, the distance that the segment pairs guarantee)."""
    if not 0 <= max_bits <= SIMHASH_BITS:
        raise ValueError("the segment pairs guarantee distances up to 3")
    schema = "key long, fp long"
    probe = distinct_fp.mapInArrow(_key_rows(True), schema).select("key", F.col("fp").alias("a"))
    index = distinct_fp.mapInArrow(_key_rows(False), schema).select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    err = [F.bit_count(x.bitwiseAND(F.lit((((1 << w) - 1) << low) - (1 << 64 if low + w == 64 else 0)).cast("long")))
           for low, w in SEGMENTS]
    first = F.lit(2)
    for p in (1, 0):
        i, j = PAIRS[p]
        first = F.when((err[i] <= 1) & (err[j] <= 1), F.lit(p)).otherwise(first)
    return (probe.join(by_key(index), "key")
            .where((F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits)
                   & (F.shiftright("key", 24) == first))
            .select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = SIMHASH_BITS,
                    keep: list[str] | None = None) -> DataFrame:
    """Every row with its fingerprint, ``component_id``, the smallest id
    reachable over links of at most ``max_bits`` differing bits, and ``root``,
    the component's smallest fingerprint as a signed number."""
    keep = list(keep or [])
    fp = cut_lineage(fingerprints(docs, shingle, keep), "fingerprints")
    groups = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    root = components(links(cut_lineage(groups.select("fp"), "distinct_fp"), max_bits), "a", "b")
    named = (groups.join(by_key(root.select(F.col("node").alias("fp"), "root")), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = join_totals(named.select("fp", "root"), low, "root").select("fp", "root", "component_id")
    return (fp.join(by_key(ids), "fp")
            .select("doc_id", *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"))
