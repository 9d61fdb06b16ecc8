"""Hashes, fingerprints and sizes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def from_hex(text: Column) -> Column:
    """A 64-bit fingerprint of 16 hexadecimal digits as a signed long; null where it is none."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("long"))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def megapixels(width: Column, height: Column) -> Column:
    return width * height / F.lit(1e6)


def median_bits(values: Column) -> Column:
    """Bits of an array against its median, as a string of 0 and 1."""
    def against_middle(ordered: Column) -> Column:
        n = F.size(ordered)
        return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / F.lit(2.0)

    # The transforms over one element sort the array, and take its middle, once and not for each value.
    middle = F.transform(F.array(F.sort_array(values)), against_middle)
    return F.get(F.transform(middle, lambda m: F.array_join(F.transform(values, lambda v: F.when(v > m, "1").otherwise("0")), "")), F.lit(0))


def to_grey(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Grey levels of decoded pixels, whose channels are blue, green, red (and alpha)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    if channels < 3:
        return x[:, :, 0].astype(np.uint8)
    # The weights of red, green and blue, in 65,536ths.
    return ((19595 * x[:, :, 2] + 38470 * x[:, :, 1] + 7471 * x[:, :, 0] + 32768) >> 16).astype(np.uint8)


def _lanczos(size: int, out: int) -> np.ndarray:
    """Weights of each old pixel in each new one: a windowed sinc of three lobes, as wide as the new pixels."""
    ratio = size / out
    wide = max(1.0, ratio)
    x = (np.arange(size)[None, :] + 0.5 - (np.arange(out)[:, None] + 0.5) * ratio) / wide
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return weights / weights.sum(1, keepdims=True)


def shrink(grey: np.ndarray, side: int) -> np.ndarray:
    """Grey levels at side x side, rounded after each direction."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = level(grey.astype(np.float64) @ _lanczos(grey.shape[1], side).T)
    return level(_lanczos(grey.shape[0], side) @ across)


def phash(pixels: np.ndarray) -> str:
    """64-bit perceptual hash of a 32 x 32 grey image: DCT-II, its low 8 x 8 corner against the median."""
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 64)
    corner = (basis @ np.asarray(pixels, float) @ basis.T)[:8, :8]
    bits = (corner > np.median(corner)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def simhash(words: pa.ListArray, rows: int = 1 << 18) -> pa.Array:
    """64-bit SimHash of each list of words: each bit is the sign of the votes of the words' md5; null without words."""
    found = words.flatten().dictionary_encode()
    heads = b"".join(hashlib.md5((w or "").encode()).digest()[:8] for w in found.dictionary.to_pylist())
    votes = np.unpackbits(np.frombuffer(heads, np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)
    code = found.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    total = np.zeros((len(words), 64), np.int64)
    for a in range(0, len(code), rows):
        b = min(a + rows, len(code))
        first = int(np.searchsorted(ends, a, "right"))
        last = int(np.searchsorted(ends, b, "left"))
        own = np.flatnonzero(np.diff(ends[first : last + 1], prepend=ends[first - 1] if first else 0)) + first
        begin = np.maximum(np.where(own > 0, ends[own - 1], 0), a) - a
        total[own] += np.add.reduceat(votes[code[a:b]], begin, axis=0, dtype=np.int64)
    bits = np.packbits(total > 0, axis=1).view(">i8").ravel().astype(np.int64)
    return pa.array(bits, pa.int64(), mask=np.diff(ends, prepend=0) == 0)
