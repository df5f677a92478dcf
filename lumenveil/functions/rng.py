"""Draws that depend only on what they are for: the same in every partitioning, in Spark, Python and DuckDB."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """In [0, 1): 52 bits of the md5 of the key's parts, joined by `|`. Strings that are no columns are constants."""
    text = F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(*key: str) -> str:
    """uniform() in DuckDB; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 13))::BIGINT / pow(2, 52))"


def uniform_int(u: Column, low: int | Column, high: int | Column) -> Column:
    """An integer of low..high, both included."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.floor(u * (high - low + 1))).cast("long")


def other_int(u: Column, original: Column, low: int, high: int) -> Column:
    """An integer of low..high but not `original`, each alike, in one draw."""
    inside = original.between(low, high)
    drawn = uniform_int(u, F.lit(low), F.when(inside, high - 1).otherwise(high))
    return F.when(inside & (drawn >= original), drawn + 1).otherwise(drawn)


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace noise of mean 0 by the inverse of its distribution; u = 0 counts as a least positive number."""
    at = F.greatest(u, F.lit(1e-15)) - 0.5
    return -(scale if isinstance(scale, Column) else F.lit(scale)) * F.signum(at) * F.log(1 - 2 * F.abs(at))


def normal(u: Column, v: Column) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-15)))) * F.cos(2 * F.pi() * v)


def gamma_whole(us: Column, rate: float) -> Column:
    """Gamma noise of whole shape: the sum of as many exponential draws as the array us has numbers."""
    return F.aggregate(us, F.lit(0.0), lambda a, u: a - F.log(F.greatest(u, F.lit(1e-15)))) / rate


def stream(keys: np.ndarray, n: int) -> np.ndarray:
    """n numbers in (0, 1) for each 64-bit key, inside a task: a row depends on its key only."""
    x = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) / (1 << 52) + 2.0**-53


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xxhash64(parts: list[pa.ChunkedArray | int | str], n: int) -> np.ndarray:
    """Spark's xxhash64 of n rows inside a task: columns of int or long, whole numbers as int, texts of up to 31 bytes. Nulls don't count."""
    turn = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    long = lambda h, x: turn(h ^ (turn(x * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3]
    short = lambda h, x: turn(h ^ (x * _P[0]), 23) * _P[1] + _P[2]

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        return h ^ (h >> np.uint64(32))

    h = np.full(n, 42, np.uint64)
    for x in parts:
        if isinstance(x, str):
            b = x.encode()
            own, at = h + _P[4] + np.uint64(len(b)), 0
            while at + 8 <= len(b):
                own, at = long(own, np.full(n, int.from_bytes(b[at : at + 8], "little"), np.uint64)), at + 8
            if at + 4 <= len(b):
                own, at = short(own, np.full(n, int.from_bytes(b[at : at + 4], "little"), np.uint64)), at + 4
            for c in b[at:]:
                own = turn(own ^ np.uint64(c * int(_P[4]) % (1 << 64)), 11) * _P[0]
            h = mixed(own)
        elif isinstance(x, int):
            h = mixed(short(h + _P[4] + np.uint64(4), np.full(n, x & 0xFFFFFFFF, np.uint64)))
        else:
            value = pc.fill_null(x, 0).to_numpy()
            wide = value.dtype == np.int64
            own = mixed(long(h + _P[4] + np.uint64(8), value.view(np.uint64)) if wide else short(h + _P[4] + np.uint64(4), value.view(np.uint32).astype(np.uint64)))
            h = np.where(pc.is_valid(x).to_numpy(), own, h)
    return h.view(np.int64)


#: Constants of MD5 (RFC 1321): what each step adds, and by how much it turns.
_ADDED = [np.uint32(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
#: Keys whose digests are computed at once, small enough for a core's cache.
_AT_ONCE = 8192


def _md5_52(m: np.ndarray) -> np.ndarray:
    """The first 52 bits of the MD5 digests of padded blocks of 64 bytes, given as 16 rows of little-endian words."""
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, turned, some = np.empty_like(a), np.empty_like(a), m.any(axis=1)
    for r in range(64):
        if r < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif r < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif r < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _ADDED[r]
        word = (r, (5 * r + 1) % 16, (3 * r + 5) % 16, 7 * r % 16)[r // 16]
        if some[word]:
            f += m[word]
        np.right_shift(f, np.uint32(32 - _TURNS[r]), out=turned)
        f <<= np.uint32(_TURNS[r])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(0x67452301)
    b += np.uint32(0xEFCDAB89)
    return (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap().astype(np.uint64) >> np.uint64(12))


def uniform_ranks(keys: list[str], counts: np.ndarray, what: str) -> np.ndarray:
    """uniform(key, i, what) inside a task, for i from 1 to each key's count, one key after the other. Keys that fit one block of
    MD5 with what follows them are hashed many at a time."""
    heads = [k.encode() for k in keys]
    size, most = np.array([len(h) for h in heads], np.int64), int(counts.max(initial=0))
    tails = [f"|{i}|{what}".encode() for i in range(1, most + 1)]
    width = len(tails[-1]) + 1 if tails else 0
    tail = np.frombuffer(b"".join((t + b"\x80").ljust(width, b"\0") for t in tails), np.uint8).reshape(most, width)
    ends = np.array([len(t) for t in tails], np.int64)
    of = np.repeat(np.arange(len(heads)), counts)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.empty(len(of), np.uint64)
    short = size + width <= 56
    block = np.zeros((len(heads), 64), np.uint8)
    flat = np.frombuffer(b"".join(h for h, s in zip(heads, short, strict=True) if s), np.uint8)
    own = np.where(short, size, 0)
    block[np.repeat(np.arange(len(heads)), own), np.arange(len(flat)) - np.repeat(np.cumsum(own) - own, own)] = flat
    some = np.flatnonzero(short[of])
    for at in range(0, len(some), _AT_ONCE):
        part = some[at : at + _AT_ONCE]
        k, i = of[part], rank[part]
        rows = block[k]
        rows.reshape(-1)[(np.arange(len(k)) * 64 + size[k])[:, None] + np.arange(width)] = tail[i]
        words = np.ascontiguousarray(rows.view("<u4").T)
        words[14] = (size[k] + ends[i]) * 8
        out[part] = _md5_52(words)
    for n in np.flatnonzero(~short[of]):
        out[n] = int.from_bytes(hashlib.md5(heads[of[n]] + tails[rank[n]]).digest()[:7], "big") >> 4
    return out.astype(np.float64) / (1 << 52)
