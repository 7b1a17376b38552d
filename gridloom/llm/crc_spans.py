"""CRC-32 of very many short byte spans at once, and the words of texts as byte spans.

Without its start and end value a CRC is linear: the checksum of a span is the XOR of what every byte adds, and that
depends only on the byte and its distance from the end of the span.  ``CONTRIBUTION`` holds these values for ``DEPTH``
distances, so the spans of a batch need one table lookup per byte and one ``bitwise_xor.reduceat``.  The start and end
value add a constant per length (the checksum of that many zero bytes).  Longer spans are cut into blocks of ``DEPTH``
bytes; neighbouring blocks are folded in pairs, each left one moved past the bytes of its right one by four lookups.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa

DEPTH = 32
SLICE = 1 << 21  # bytes of spans looked up at a time


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


def _contributions() -> np.ndarray:
    """What byte b at distance d from the end of a span adds to its checksum."""
    step = _byte_table()
    rows = [step]
    for _ in range(DEPTH - 1):
        rows.append((rows[-1] >> 8) ^ step[rows[-1] & 0xFF])
    return np.stack(rows)


CONTRIBUTION = _contributions()
FLAT = CONTRIBUTION.ravel()
ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], dtype=np.uint32)


@functools.lru_cache(maxsize=None)
def _mover(level: int) -> np.ndarray:
    """Four tables of 256 values that move a linear checksum past ``DEPTH << level`` further bytes."""
    if level == 0:
        # Byte i of the checksum is XORed into the message byte at distance DEPTH - 1 - i of the block that follows.
        return np.stack([CONTRIBUTION[DEPTH - 1 - i] for i in range(4)])
    half = _mover(level - 1)
    return np.stack([_moved(half[i], half) for i in range(4)])


def _moved(values: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][values & 0xFF]
    for i in range(1, 4):
        out = out ^ tables[i][(values >> np.uint32(8 * i)) & 0xFF]
    return out


def _linear(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Linear part of the checksums of spans of 1 to ``DEPTH`` bytes."""
    first = np.cumsum(lengths) - lengths
    along = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    distance = np.repeat(lengths - 1, lengths) - along
    values = FLAT[distance * 256 + data[np.repeat(starts, lengths) + along]]
    return np.bitwise_xor.reduceat(values, first)


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Linear part of the checksums of spans longer than ``DEPTH``; the first block of a span may be short."""
    n_blocks = -(-lengths // DEPTH)
    head = lengths - (n_blocks - 1) * DEPTH
    span = np.repeat(np.arange(len(starts)), n_blocks)
    number = np.arange(len(span)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    at = starts[span] + np.where(number > 0, head[span] + (number - 1) * DEPTH, 0)
    size = np.where(number > 0, DEPTH, head[span])
    values = np.concatenate([_linear(data, at[i : i + SLICE // DEPTH], size[i : i + SLICE // DEPTH])
                             for i in range(0, len(at), SLICE // DEPTH)])
    level = 0
    while (n_blocks > 1).any():
        # An empty block in front makes the number of blocks even; it adds nothing.
        odd = (n_blocks & 1) & (n_blocks > 1)
        padded = np.zeros(len(values) + int(odd.sum()), dtype=np.uint32)
        padded[np.arange(len(values)) + np.repeat(np.cumsum(odd), n_blocks)] = values
        n_blocks = n_blocks + odd
        single = np.repeat(n_blocks == 1, n_blocks)
        paired = padded[~single]
        joined = _moved(paired[0::2], _mover(level)) ^ paired[1::2]
        halves = np.where(n_blocks == 1, 1, n_blocks // 2)
        values = np.empty(int(halves.sum()), dtype=np.uint32)
        alone = np.repeat(n_blocks == 1, halves)
        values[alone], values[~alone] = padded[single], joined
        n_blocks, level = halves, level + 1
    return values


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start:end]`` (bytes) for every span; spans may overlap, empty ones give 0."""
    lengths = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= DEPTH))
    for i in range(0, len(short), SLICE // DEPTH):
        some = short[i : i + SLICE // DEPTH]
        out[some] = _linear(data, starts[some], lengths[some]) ^ ZEROS[lengths[some]]
    long = np.flatnonzero(lengths > DEPTH)
    if len(long):
        sizes, which = np.unique(lengths[long], return_inverse=True)
        constant = np.array([zlib.crc32(bytes(int(n))) for n in sizes], dtype=np.uint32)
        out[long] = _folded(data, starts[long], lengths[long]) ^ constant[which]
    return out


LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text in them); a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, text numbers) of the words: runs of digits, letters a-z, and bytes from 0x80."""
    lowered = LOWERED[data]
    inside = IN_WORD[lowered]
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return lowered, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, least: int, most: int):
    """(bytes, starts, ends, text numbers) of all runs of ``least`` to ``most`` consecutive words, joined by one space."""
    if least == most == 1:
        return data, starts, ends, texts
    lengths = ends - starts
    first = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
    along = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[np.repeat(first, lengths) + along] = data[np.repeat(starts, lengths) + along]
    last = first + lengths
    parts = []
    for n in range(least, most + 1):
        k = np.flatnonzero(texts[: len(texts) - n + 1] == texts[n - 1 :]) if len(texts) >= n else np.empty(0, np.int64)
        parts.append((first[k], last[k + n - 1], texts[k]))
    return joined, *(np.concatenate(p) for p in zip(*parts, strict=True))
