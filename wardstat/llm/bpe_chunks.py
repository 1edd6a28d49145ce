"""Operator 9: byte-level BPE encoding and decoding with content-defined
chunk reuse.

A text is cut where a rolling hash over its last characters has zero top
bits, so equal passages give equal chunks wherever they stand.  Each chunk is
encoded once per task, whatever number of texts share it; a cut may fall
inside a word, so the joins are then repaired.  A byte-level BPE splits text
left to right into pieces (words, numbers, marks, white space) that depend
only on the text from their start up to two characters past their end, and
never merges across them.  From the last piece of the left chunk that is
certain, the join is re-encoded into the right chunk until a piece of the
new split and a piece of the right chunk's own split begin at the same
place; from there on both splits agree to the letter.  If they do not agree
inside the first characters, the re-encoded stretch grows up to the whole
chunk and beyond, so the result always equals encoding the whole text.

The work is map-only and bounded: the chunk and piece memories of a task
have fixed limits.  Sharing chunks across tasks would need the texts and
their ids to be shuffled, which costs more than encoding them again.

Defined results: null and empty texts give no ids and decode to the empty
text; strings of added tokens inside a text become those tokens, as in the
library; repeated rows are encoded each; an empty table gives an empty
result; extra columns pass through where named in ``keep``.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: fixed values: the split pattern of byte-level BPE
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters on which the pattern means the same in every regex library
PLAIN = "\t-\r -~¡-ſ"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGITS = "0-9²³¹¼-¾"
MARGIN = 3            # a piece is certain if it ends so many characters before the end of what was split
CUT_BITS = 10         # a cut every 2^10 characters on average
WINDOW = 8            # characters under the rolling hash


def cuts(text: str) -> list[int]:
    """Content-defined cut positions of a text, without 0 and its end."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) <= WINDOW:
        return []
    h = cp * np.uint32(0x9E3779B1)
    for width, mult in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):
        h = h[:-width] * np.uint32(mult) + h[width:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + WINDOW
    return at[at < len(cp)].tolist()


def loaded(path: str):
    """The tokenizer of a file and the bytes of its ids, loaded once per Python worker,
    which runs many tasks: loading takes time, and what a dropped tokenizer held
    is not all given back.  Kept with the library's module, since the functions
    of this one travel by value and each task has globals of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    known = vars(tokenizers).setdefault("_loaded_by_path", {})
    if path not in known:
        tok = tokenizers.Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        known[path] = tok, token_bytes(tok)
    return known[path]


class ChunkEncoder:
    """Encoder of one task: remembers pieces and chunks up to fixed limits."""

    def __init__(self, path: str, pieces: int = 200_000, chunks: int = 8_000):
        self.tok, self._bytes = loaded(path)
        self.spaced = np.array([b[:1] == b" " for b in self._bytes])
        # the same pattern for PLAIN text, where letters are the ASCII and Latin ones
        self.find = re.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{LETTERS}{DIGITS}]").replace(r"\p{L}", f"[{LETTERS}]")
                               .replace(r"\p{N}", f"[{DIGITS}]")).findall
        self.odd = regex.compile(f"[^{PLAIN}]").search
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.piece: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunk: dict[str, tuple[list[bytes], np.ndarray]] = {}
        self.piece_limit, self.chunk_limit = pieces, chunks
        self.encoded = self.reused = self.repaired = 0

    def split(self, text: str) -> list[str]:
        if self.odd(text) is None:
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Codes of the pieces, from memory or encoded now."""
        try:
            return list(map(self.piece.__getitem__, pieces))
        except KeyError:
            self._remember(set(pieces))
            return list(map(self.piece.__getitem__, pieces))

    def _remember(self, pieces: set[str]) -> None:
        """Make the pieces known.  A full memory becomes the older one, from
        which pieces that come again are taken over, and the one before goes."""
        new = pieces.difference(self.piece)
        if len(self.piece) + len(new) > self.piece_limit:
            self.older, self.piece, new = self.piece, {}, pieces
        known, older = self.piece, self.older
        if older:
            known.update({p: older[p] for p in new if p in older})
            new = new.difference(known)
        if len(new) > 32:
            # words with a leading space split again at the same places when they
            # stand in one text, so one call encodes them all, and every word begins
            # with the one code of its own that holds a space
            words = [p for p in new if p[0] == " " and p[1:].isalpha()]
            ids = np.array(self.tok.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
            at = (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            if len(at) == len(words) + 1:
                raw = ids.tobytes()
                known.update(zip(words, [raw[a:b] for a, b in zip(at, at[1:])]))
                new = new.difference(words)
        rest = list(new)
        if rest:
            for p, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
                known[p] = np.array(e.ids, "<u4").tobytes()

    def learn(self, texts: list[str]) -> None:
        """Encode the chunks of a batch that are not known yet, in one call."""
        fresh: dict[str, list[str]] = {}
        for text in texts:
            for part in self._plain(text):
                at = [0, *cuts(part), len(part)]
                for a, b in zip(at, at[1:]):
                    c = part[a:b]
                    if c in self.chunk or c in fresh:
                        self.reused += 1
                    else:
                        fresh[c] = self.split(c)
        if len(self.chunk) + len(fresh) > self.chunk_limit:
            self.chunk.clear()
        if fresh:
            self._remember(set().union(*fresh.values()))
        for c, pieces in fresh.items():
            self.encoded += 1
            self.chunk[c] = (self._ids(pieces), np.fromiter(map(len, pieces), np.int32, len(pieces)))

    def _plain(self, text: str) -> list[str]:
        return self.special.split(text)[::2] if self.special else [text]

    def _chunk(self, c: str):
        if c not in self.chunk:
            pieces = self.split(c)
            if len(self.chunk) >= self.chunk_limit:
                self.chunk.clear()
            self.encoded += 1
            self.chunk[c] = (self._ids(pieces), np.fromiter(map(len, pieces), np.int32, len(pieces)))
        return self.chunk[c]

    def _join(self, text: str) -> list[bytes]:
        """Codes of the pieces of a text without added tokens."""
        n, out, done = len(text), [], 0      # pieces up to position `done` are certain
        at = [0, *cuts(text), n]
        for lo, hi in zip(at, at[1:]):
            codes, sizes = self._chunk(text[lo:hi])
            ends = np.cumsum(sizes) + lo
            first = 0
            if done < lo:
                self.repaired += 1
                reach, first = 16, None
                while first is None:
                    stop = min(hi, lo + reach)
                    again = self.split(text[done:stop])
                    new = np.cumsum([len(p) for p in again]) + done
                    sure = int(np.searchsorted(new, n if stop == n else stop - MARGIN, "right"))
                    own = np.concatenate([[lo], ends])
                    agreed = [k for k in range(sure) if new[k] >= lo and own[min(len(own) - 1, np.searchsorted(own, new[k]))] == new[k]]
                    if agreed:
                        k = agreed[0]
                        out += self._ids(again[:k + 1])
                        done = int(new[k])
                        first = int(np.searchsorted(own, done))
                    elif stop == hi:         # no agreement inside this chunk: go on from what is certain
                        out += self._ids(again[:sure])
                        done = int(new[sure - 1]) if sure else done
                        break
                    else:
                        reach *= 4
                if first is None:
                    continue
            last = int(np.searchsorted(ends, n if hi == n else hi - MARGIN, "right"))
            if last > first:
                out += codes[first:last]
                done = int(ends[last - 1])
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text (little-endian unsigned 32-bit)."""
        text = text or ""
        if self.special is None or self.special.search(text) is None:
            return np.frombuffer(b"".join(self._join(text)), "<u4")
        out: list[bytes] = []
        for k, part in enumerate(self.special.split(text)):
            out += [np.array([self.added[part]], "<u4").tobytes()] if k % 2 else self._join(part)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self._bytes[ids].tolist()).decode("utf-8", "replace")


def token_bytes(tok) -> np.ndarray:
    """The bytes of every id.  Byte-level vocabularies write a byte as itself
    where it is a visible Latin-1 character, the others as code points from
    256 on in byte order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in visible}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    added = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    out = np.empty(tok.get_vocab_size(with_added_tokens=True), object)
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = added[i].encode() if i in added else bytes(back[c] for c in token)
    return out


def encode_rows(docs: DataFrame, path: str, keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """``keep`` columns (doc_id by default) with n_tokens, the digests of the
    ids and of the decoded text and, if asked for, the ids themselves."""
    keep = list(keep if keep is not None else ["doc_id"])
    src = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        enc = ChunkEncoder(path)
        for b in batches:
            n, d_ids, d_text, raw = [], [], [], []
            texts = b["_text"]
            for at in range(0, b.num_rows, 128):
                group = [t or "" for t in texts.slice(at, 128).to_pylist()]
                enc.learn(group)
                for t in group:
                    code = enc.encode(t)
                    n.append(len(code))
                    d_ids.append(hashlib.sha256(code).hexdigest())
                    d_text.append(hashlib.sha256(enc.decode(code).encode("utf-8")).hexdigest())
                    raw.append(code.tobytes() if ids else None)
            cols = [*[b[c] for c in keep], pa.array(n, pa.int64()), pa.array(d_ids, pa.string()), pa.array(d_text, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([*[src.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                           *([T.StructField("ids", T.BinaryType())] if ids else [])])
    return src.mapInArrow(run, schema)
