"""Words of whole texts and their 64-bit hashes, for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULT = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker keeps, at most, and bytes of text that are looked at together, at least one text.
KEEP, BYTES = 150_000, 4_000_000
#: A-Z to a-z in UTF-8; bytes.split() then cuts at x20 and x09 to x0D, as the words are defined.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of a word that are hashed place by place.
LONG = 64


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `size` bytes of text, so that a worker's memory is bounded whatever the batch is."""
    n = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        base = n[first - 1] if first else 0
        last = max(int(np.searchsorted(n, base + size, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def hashed(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of an array's strings (FNV-1a over their UTF-8 bytes, mixed), a byte place of all at a time."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32, len(strings) + 1, strings.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, size = at[:-1][order], size[order]
    h = np.full(len(order), 0xCBF29CE484222325, np.uint64)
    live = np.searchsorted(-size, -np.arange(min(int(size[0]), LONG)), side="left")
    for j, k in enumerate(live):
        h[:k] = (h[:k] ^ data[start[:k] + j]) * np.uint64(0x100000001B3)
    for k in range(int((size > LONG).sum())):  # rare: the rest of a long word at once
        h[k] ^= np.uint64(xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]]))
    out = np.empty_like(h)
    out[order] = mixed(h + size.astype(np.uint64))
    return out


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, place, sizes): distinct word hashes, each word's place among them, and words of each text.

    Words lie between x20 and x09 to x0D; lower: with A-Z as a-z. A null text has none.
    """
    texts = pc.fill_null(texts, "").cast(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    place, hashes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), hashed(coded.dictionary)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # at a text's ends
        kept = place != blank
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        place = place[kept]
        place -= place > blank
        hashes = np.delete(hashes, blank)
    return hashes, place, sizes


def spaced_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def word_hashes(words: list[bytes], known: dict) -> np.ndarray:
    """64-bit hashes of one text's words, another way, which is faster for few words; known keeps them, up to KEEP."""
    got = list(map(known.get, words))
    if None in got:
        if len(known) > KEEP:
            known.clear()
        for i, w in enumerate(words):
            if got[i] is None:
                h = known.get(w)
                got[i] = known[w] = xxhash.xxh3_64_intdigest(w) if h is None else h
    return np.array(got, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULT
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
