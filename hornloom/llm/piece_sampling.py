"""SentencePiece encoding by sampling and lossless decoding: forward filtering, backward sampling over the piece lattice.

The lattice of a text has an edge for every piece that matches at a position, and a byte-fallback edge for a character without a piece of its own.
Forward filtering sums the weights of all segmentations of each prefix; backward sampling then draws pieces from the end, each with its exact
conditional probability. Random numbers are a hash of the row key, the word's place and the step, so a row has the same segmentation wherever and however often it is encoded.

The given model is BPE, whose scores are merge ranks: a piece of rank r gets the weight (1 / (r + SHIFT)) ** alpha (Zipf's law over ranks). The lattice falls apart
at the starts of words (no piece crosses into a space) and at characters that no piece holds, so it is filtered once per distinct word of a
chunk, with numpy over all words of a chunk together; longer words than LONG are filtered one by one with rescaling.

No normalisation is applied: a space stands for U+2581, a real U+2581 is written as bytes, and a space is put in front of a text that is not
empty (dropped by decoding), so decoding gives back every text exactly.

Defined cases: null and empty texts have no pieces and decode to null or the empty text. A null key is the key ''. Repeated rows get equal pieces. Extra columns are ignored. Texts of
any length are encoded whole, in chunks of about CHUNK bytes or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Production parameters. The path of the model is a parameter; the file is not part of this package.
MODEL, ALPHA, SHIFT, CHUNK, LONG, BLOCK = "/opt/tokenizers/piece_bpe_32k.model", 1.0, 10.0, 1_000_000, 48, 4096

_GAP, _REAL_GAP = 0x2581, 0x110001  # the code of a space, and that of a real U+2581
_LIMIT = 0x110002
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers from which the hash of any slice follows."""
    n = len(codes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64)])
    return total, _powers(_BACK, n)


def _slices(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, back = sums
    return _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[c == _GAP] = _REAL_GAP
    c[c == 0x20] = _GAP
    return c


@dataclass
class Vocabulary:
    """Pieces as hashes in ascending order with ids and log weights, the bytes of each id, the id of each byte, and the hashes of all proper beginnings."""

    hashes: np.ndarray
    ids: np.ndarray
    logs: np.ndarray
    raw: list[bytes]
    byte_ids: np.ndarray
    byte_log: float
    known: np.ndarray
    longest: int
    starts: np.ndarray

    def __post_init__(self) -> None:
        # First tests by one bit each: most slices start no piece, and most others are none.
        self.bits, self.start_bits = np.zeros(1 << 20, bool), np.zeros(1 << 21, bool)
        self.bits[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.start_bits[(self.starts & np.uint64(0x1FFFFF)).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k not in ("bits", "start_bits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def may_go_on(self, h: np.ndarray) -> np.ndarray:
        """False where no longer piece starts with the slice."""
        return self.start_bits[(h & np.uint64(0x1FFFFF)).astype(np.int64)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in `ids` of the hashes, -1 where no piece has one."""
        out = np.full(h.shape, -1, np.int64)
        maybe = np.nonzero(self.bits[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == h[maybe], at, -1)
        return out


def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    raw = [b""] * n
    byte_ids = np.full(256, -1, np.int64)
    plain = []
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            raw[i], byte_ids[int(p[3:5], 16)] = bytes([int(p[3:5], 16)]), i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            raw[i] = p.replace("▁", " ").encode()
            plain.append(i)
    if (byte_ids < 0).any():
        raise ValueError("the model needs byte fallback for a lossless round trip")
    if any("▁" in p.lstrip("▁") for p in (pieces[i] for i in plain)):
        raise ValueError("pieces of this model cross words")
    codes = [np.frombuffer(pieces[i].encode("utf-32-le"), np.uint32) for i in plain]
    h = np.array([_slices(_sums(c), np.array([0]), np.array([len(c)]))[0] for c in codes], np.uint64)
    rank = np.array([min(-sp.get_score(i), n) for i in plain])
    order = np.argsort(h)
    known = np.zeros(_LIMIT, bool)
    known[np.unique(np.concatenate(codes))] = True
    starts = np.array(sorted({int(x) for c in codes if len(c) > 1 for x in _slices(_sums(c), np.zeros(len(c) - 1, np.int64), np.arange(1, len(c)))}), np.uint64)
    return Vocabulary(h[order], np.array(plain)[order], (-alpha * np.log(rank + SHIFT))[order], raw, byte_ids, -alpha * float(np.log(n + SHIFT)), known, max(map(len, codes)), starts)


def _byte_length(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + ((code >= 0x10000) & (code < 0x110000))


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    return (_mix(seed + np.uint64(_BASE * (step + 1) % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _lattice(v: Vocabulary, sums, codes: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """log weight and id of the edge that ends before place e + 1 and has l + 1 characters, for words of one length: arrays (word, e, l).

    The id of a byte-fallback edge is -1 - code.
    """
    top = min(length, v.longest)
    logs = np.full((len(start), length, top), -np.inf)
    ids = np.zeros((len(start), length, top), np.int64)
    word, at = (x.ravel() for x in np.indices((len(start), length)))
    used = 1
    code = codes[start[:, None] + np.arange(length)].astype(np.int64)
    logs[:, :, 0], ids[:, :, 0] = v.byte_log * _byte_length(code), -1 - code
    for size in range(1, top + 1):
        fits = at + size <= length
        word, at = word[fits], at[fits]
        first = start[word] + at
        h = _slices(sums, first, first + size)
        found = v.find(h)
        hit = found >= 0
        used = size if hit.any() else used
        place = word[hit], at[hit] + size - 1, size - 1
        logs[place], ids[place] = v.logs[found[hit]], v.ids[found[hit]]
        more = v.may_go_on(h)
        word, at = word[more], at[more]
        if not len(word):
            break
    return logs[:, :, :used], ids[:, :, :used]  # no longer edge is in these words


def _filtered(logs: np.ndarray) -> np.ndarray:
    """Cumulative weights over edge sizes at each place, from forward filtering; rescaled at each place, so of any length."""
    words, length, top = logs.shape
    alpha = np.zeros((words, length + 1))  # log of the summed weight of all segmentations up to a place
    cum = np.empty_like(logs)
    for e in range(length):
        n = min(e + 1, top)
        x = logs[:, e, :n] + alpha[:, e::-1][:, :n]
        most = x.max(axis=1, keepdims=True)
        y = np.cumsum(np.exp(x - most), axis=1)
        cum[:, e, :n], cum[:, e, n:] = y, y[:, -1:]
        alpha[:, e + 1] = most[:, 0] + np.log(y[:, -1])
    return cum


def encode(v: Vocabulary, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
    """The sampled ids of each text; seeds: one unsigned 64-bit number for each."""
    if not texts:
        return []
    parts = [_codes(t) if t else np.empty(0, np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    codes = np.concatenate(parts)
    if not len(codes):
        return [np.empty(0, np.int32)] * len(texts)
    row_start = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(len(codes), bool)
    first[row_start[:-1][sizes > 0]] = True
    gap, known = codes == _GAP, v.known[codes]
    cut = first | ~known
    cut[1:] |= (gap[1:] & ~gap[:-1]) | ~known[:-1]
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(codes))
    row = np.searchsorted(row_start, start, side="right") - 1
    before = np.searchsorted(start, row_start[:-1])  # the first word of each row
    seed = _mix(seeds[row] + (np.arange(len(start)) - before[row]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sums = _sums(codes)
    _, model, which = np.unique(_slices(sums, start, end), return_index=True, return_inverse=True)
    length = (end - start)[model]
    by_word = np.argsort(which, kind="stable")
    at = np.searchsorted(which[by_word], np.arange(len(model) + 1))
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    count = np.zeros(len(start), np.int64)
    order = np.argsort(length, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        size = int(length[group[0]])
        step_words = max(1, BLOCK * 16 // max(16, size * min(size, v.longest)) * 4) if size <= LONG else 1
        for i in range(0, len(group), step_words):
            block = group[i : i + step_words]
            logs, ids = _lattice(v, sums, codes, start[model[block]], size)
            cum = _filtered(logs)
            n = at[block + 1] - at[block]
            word = np.repeat(np.arange(len(block)), n)
            inside = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            occ = by_word[np.repeat(at[block], n) + inside]
            place = np.full(len(occ), size)
            step = 0
            while len(occ):
                c = cum[word, place - 1]
                u = _uniform(seed[occ], step) * c[:, -1]
                edge = np.minimum((c <= u[:, None]).sum(axis=1), np.minimum(place, c.shape[1]) - 1)
                held.append((occ, ids[word, place - 1, edge], step))
                place = place - edge - 1
                step += 1
                ended = place == 0
                count[occ[ended]] = step
                live = ~ended
                occ, word, place = occ[live], word[live], place[live]
    last = np.cumsum(count)
    out = np.empty(last[-1], np.int64)
    for occ, found, step in held:
        out[last[occ] - 1 - step] = found
    word_rows = np.concatenate([[0], last])[np.append(before, len(start))]
    low = out < 0
    if low.any():  # byte fallback: one id for each byte
        code = np.where(low, -1 - out, 0)
        code[code == _REAL_GAP] = _GAP
        n = np.where(low, _byte_length(code), 1)
        ends = np.cumsum(n)
        wide = np.repeat(out, n)
        for b in range(4):
            of = low & (n > b)
            x, m = code[of], n[of]
            lead = np.select([m == 1, m == 2, m == 3], [x, 0xC0 | x >> 6, 0xE0 | x >> 12], 0xF0 | x >> 18)
            wide[ends[of] - m + b] = v.byte_ids[lead if b == 0 else 0x80 | (x >> (6 * (m - 1 - b)) & 0x3F)]
        word_rows = np.concatenate([[0], ends])[word_rows]
        out = wide
    return [out[a:b].astype(np.int32) for a, b in zip(word_rows[:-1], word_rows[1:], strict=True)]


def decode(v: Vocabulary, ids: np.ndarray | list[int]) -> str:
    return b"".join(map(v.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "surrogatepass")[1:]


def seed_of(key: object, salt: int = 0) -> int:
    return int.from_bytes(blake2b(f"{salt}:{'' if key is None or key != key else key}".encode(), digest_size=8).digest(), "little")


def _pieces(v: Vocabulary, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:
                # As many rows as fit into a chunk, one at least; only their texts become Python objects.
                j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), CHUNK, side="right")))
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = encode(v, texts, np.array([seed_of(k, salt) for k in part.column(0).to_pylist()], np.uint64))
                counts = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                whole = [decode(v, x) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32())), pa.array(counts), pa.array(whole), *part.columns[2:]], ["key", "ids", "n_pieces", "lossless", *part.schema.names[2:]])
                i = j

    return run


def sample_pieces(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, salt: int = 0, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, ids, n_pieces, lossless (decoding gave the text back) and the carried columns for each row."""
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *carry)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    # The vocabulary travels with the function: a few hundred kilobytes, whatever the corpus.
    return d.mapInArrow(_pieces(load(path, alpha), salt), f"key {kind}, ids array<int>, n_pieces long, lossless boolean{more}").withColumnRenamed("key", key)


def _texts(v: Vocabulary):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "text": [None if x is None else decode(v, x) for x in f["ids"]]})

    return run


def decode_pieces(encoded: DataFrame, path: str = MODEL, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text for each row of ids."""
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInPandas(_texts(load(path)), f"key {kind}, text string").withColumnRenamed("key", key)
