"""Operator 10: benchmark decontamination by spaced-seed hashing.

Fixed masks of kept (1) and ignored (0) token positions slide over the
benchmark items and over every training text; equal hashes of the kept
tokens are hits, and around each hit the two token sequences are compared
on its diagonal.  A text overlaps an item where a window of ``window``
aligned tokens differs in at most ``substitutions`` of them.  The two masks of
weight six have a placement without error inside every 13-token window with
any 2 substitutions (a test goes through all of them), so the search is
exact for the default window.  Shorter items must match as a whole: with one
substitution from ``tolerant`` tokens on (their masks are their halves, one of
which is then without error), without any below; and an item of fewer than
``least`` tokens says too little inside a longer text, so it overlaps only a
text that consists of it.

Scale: training texts are read once, in place, with no shuffle.  The seeds
of the benchmark go to the executors in blocks of at most ``block_tokens``
tokens; their size is summed before anything is sent, and a benchmark beyond
one block makes further passes over the texts, each written before the next,
so that a task holds one block at a time.

Defined results: null, empty and token-less texts overlap nothing; tokens
are lower-cased words stripped of outer punctuation; repeated items or rows
are reported each; null item ids take part and are reported as null; an
empty benchmark or table gives no overlaps; extra columns pass through where
named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from .common import WordHash

MASKS = ("11010111", "111001011")


@dataclass(frozen=True)
class SeedParams:
    masks: tuple[str, ...] = MASKS
    window: int = 13
    substitutions: int = 2
    tolerant: int = 7                 # tokens from which on a short item may differ in one
    least: int = 5                    # tokens of an item that is looked for inside longer texts
    block_tokens: int = 2_000_000     # bound of what one pass broadcasts


OVERLAP = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first", T.IntegerType()),
                                    T.StructField("last", T.IntegerType())]))
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»“”‘’…"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normal(word: str) -> str:
    return word.lower().strip(_STRIP)


def tokens(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


class _Ids(WordHash):
    """raw word -> 64-bit hash of its normal form; 0 for words of marks only."""

    def __missing__(self, word: str) -> int:
        key = normal(word)
        h = hash_of(key) if key else 0
        if len(self) < self.limit:
            self[word] = h
        return h


def hash_of(token: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 99) | 1


def seed_hashes(h: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of the kept tokens at every placement of one mask."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(offsets) * 64 + offsets[-1], np.uint64)
    for o in offsets:
        out = (out ^ h[o:o + n]) * _MULT
        out ^= out >> np.uint64(29)
    return out


def overlap_runs(a: list[str], b: list[str], shift: int, p: SeedParams = SeedParams()):
    """Runs of item tokens ``a`` covered by a window that matches ``b`` on the
    diagonal ``shift`` (b index = a index + shift), as (first, last) in b."""
    window, allowed = p.window, p.substitutions
    if len(a) < window:
        window, allowed = len(a), min(allowed, int(len(a) >= p.tolerant))
    if len(a) < p.least and len(a) != len(b):
        return []
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    if hi - lo < window:
        return []
    miss = np.cumsum([0] + [a[k] != b[k + shift] for k in range(lo, hi)])
    good = np.flatnonzero(miss[window:] - miss[:-window] <= allowed)
    runs: list[list[int]] = []
    for g in good.tolist():
        first, last = lo + shift + g, lo + shift + g + window - 1
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    return [tuple(r) for r in runs]


def item_masks(n: int, p: SeedParams) -> list[tuple[tuple[int, ...], list[int] | None]]:
    """Masks of an item of ``n`` tokens, as kept offsets, and where they are
    placed (None: everywhere)."""
    if n >= p.window:
        return [(tuple(i for i, c in enumerate(m) if c == "1"), None) for m in p.masks]
    if n >= p.tolerant and p.substitutions:
        return [(tuple(range(n // 2)), [0, n - n // 2])]
    return [(tuple(range(n)), None)] if n else []


def _seed_table(items: list[tuple], p: SeedParams):
    """Sorted seed hashes with item and offset, for each mask."""
    toks = [tokens(t) for _, t in items]
    masks: dict[tuple[int, ...], list] = {}
    for k, words in enumerate(toks):
        h = np.array([hash_of(w) for w in words], np.uint64)
        for offsets, places in item_masks(len(words), p):
            for at, s in enumerate(seed_hashes(h, list(offsets)).tolist()):
                if places is None or at in places:
                    masks.setdefault(offsets, []).append((s, k, at))
    table = {}
    for offsets, rows in masks.items():
        rows.sort()
        table[offsets] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32),
                          np.array([r[2] for r in rows], np.int32))
    return [i for i, _ in items], toks, table


def _scan(sent, p: SeedParams, names: list[str]):
    def run(batches):
        ids, items, table = sent.value
        hashes = _Ids(0)
        sieve = {o: np.bincount((t[0] >> np.uint64(44)).astype(np.int64), minlength=1 << 20).astype(bool)
                 for o, t in table.items()}
        for b in batches:
            texts, before = b["_text"], b["overlaps"]
            out = []
            for at in range(0, b.num_rows, 256):
                for text in texts.slice(at, 256).to_pylist():
                    raw = (text or "").split()
                    h = np.fromiter(map(hashes.__getitem__, raw), np.uint64, len(raw))
                    real = h != 0
                    if not real.all():
                        h = h[real]
                    pairs = set()
                    for offsets, (seeds, item, place) in table.items():
                        s = seed_hashes(h, list(offsets))
                        maybe = np.flatnonzero(sieve[offsets][(s >> np.uint64(44)).astype(np.int64)])
                        if not len(maybe):
                            continue
                        left = np.searchsorted(seeds, s[maybe], "left")
                        right = np.searchsorted(seeds, s[maybe], "right")
                        for pos, l, r in zip(maybe.tolist(), left.tolist(), right.tolist()):
                            for k in range(l, r):
                                pairs.add((int(item[k]), pos - int(place[k])))
                    found = []
                    if pairs:
                        words = tokens(text)
                        for k, shift in sorted(pairs):
                            found += [{"item_id": ids[k], "first": x, "last": y} for x, y in
                                      overlap_runs(items[k], words, shift, p)]
                    out.append(found)
            merged = [(x or []) + y for x, y in zip(before.to_pylist(), out)]
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in names], b["_text"], pa.array(merged, pa.list_(pa.struct(
                    [("item_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])))],
                names=[*names, "_text", "overlaps"])
    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, p: SeedParams = SeedParams(), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row with ``overlaps``: item_id and the first
    and last token position (in the text's tokens) of each overlapping run."""
    keep = list(keep if keep is not None else ["doc_id"])
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0          # a token takes two characters at least
    blocks = -(-total // (2 * p.block_tokens))
    src = docs.select(*keep, F.col("text").alias("_text"), F.lit(None).cast(OVERLAP).alias("overlaps"))
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sent = spark.sparkContext.broadcast(_seed_table(rows, p))
        src = src.mapInArrow(_scan(sent, p, keep), src.schema)
        if blocks > 1:
            src = cut_lineage(src, "decontamination")
            sent.destroy()
    return src.drop("_text").withColumn("overlaps", F.coalesce("overlaps", F.array().cast(OVERLAP)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: SeedParams = SeedParams()) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, unchanged."""
    whole = docs.select("text", F.struct("*").alias("__row"))
    return overlaps(whole, benchmark, p, ["__row"]).where(F.size("overlaps") == 0).select("__row.*")
