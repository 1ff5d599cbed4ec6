"""Array work on the UTF-8 buffers of Arrow string columns: words, hashes, window anchors.

All functions are pure NumPy on the rows of one task. Hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK = 1 << 18

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A scrambled value for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def chunks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges with at most `most` elements together, or one row."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the number of words before it."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """Scrambled value of the eight bytes from each position on (zeros after the end)."""
    padded = np.concatenate([raw, np.zeros(7, np.uint8)])
    return mix(np.ndarray(len(raw), "<u8", padded.data, 0, (1,)).astype(np.uint64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from all its bytes and its length."""
    out = np.empty(len(starts), np.uint64)
    b = 0
    while b < len(starts):
        a, b = b, max(b + 1, int(np.searchsorted(ends, starts[b] + CHUNK, side="right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTES.take(raw[lo:hi]) * up[: hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return out


def gram_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive items (empty if there are fewer)."""
    if len(items) < n:
        return np.empty(0, np.uint64)
    out = items[: len(items) - n + 1].copy()
    for k in range(1, n):
        out *= BASE
        out += items[k : len(items) - n + 1 + k]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive values, three passes whatever w is."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def sums(items: np.ndarray) -> np.ndarray:
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * powers(len(items))[0][: len(items)], out=total[1:])
    return total


def span_hash(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of items[a:b] from the running sums; depends on the items and their number."""
    _, down = powers(len(total))
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def anchor_runs(items: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> dict:
    """Windows of `window` items, grouped by the gram that anchors them.

    Each window is anchored at its gram of least hash (leftmost of equals), so equal windows
    have equal anchors at equal places. Consecutive windows with the same anchor make
    a run. Row r owns items[bounds[r] : bounds[r + 1]]; windows never cross rows. For each run:
    row; lo and n, its first window's start within the row and its number of windows; p, the
    anchor's start; h, the anchor's hash; c, the hash of all items any window with this anchor
    could have, which settles the run's windows completely.
    """
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "lo", "n", "p", "h", "c")}
    lengths = np.diff(bounds)
    w = window - gram + 1
    for a, b in chunks(lengths, CHUNK):
        size = int(bounds[b] - bounds[a])
        if size < window:
            continue
        if b == a + 1 and size > 2 * CHUNK:  # one very long row: overlapping pieces
            pieces = [
                (max(0, s - w), min(size, s + CHUNK + window + w), s, s + CHUNK)
                for s in range(0, size, CHUNK)
            ]
        else:
            pieces = [(0, size, 0, size)]
        for left, right, keep_from, keep_to in pieces:
            if right - left < window:
                continue
            part = items[bounds[a] + left : bounds[a] + right]
            edges = np.clip(bounds[a : b + 1] - bounds[a] - left, 0, len(part))
            total = sums(part)
            s = np.arange(len(part) - gram + 1)
            grams = span_hash(total, s, s + gram)
            key = (grams & np.uint64(0xFFFFFFFF00000000)) | s.astype(np.uint64)
            at = (sliding_min(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # for each start, the end of its row
            end = np.repeat(edges[1:], np.diff(edges))[: len(at)]
            ok = np.flatnonzero(np.arange(len(at)) + window <= end)
            if not len(ok):
                continue
            p = at[ok]
            new = np.ones(len(ok), bool)
            new[1:] = (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(ok)))
            lo, p = ok[first], p[first]
            keep = (p + left >= keep_from) & (p + left < keep_to)
            lo, p, count = lo[keep], p[keep], count[keep]
            row = np.searchsorted(edges, p, side="right") - 1
            begin, stop = edges[row], edges[row + 1]
            c_from, c_to = np.maximum(p - w + 1, begin), np.minimum(p + window, stop)
            context = span_hash(total, c_from, c_to) ^ mix((p - c_from).astype(np.uint64))
            shift = left if b == a + 1 else 0
            base = begin if b > a + 1 else np.zeros_like(begin)
            out["row"].append(row + a)
            out["lo"].append(lo - base + shift)
            out["n"].append(count)
            out["p"].append(p - base + shift)
            out["h"].append(grams[p])
            out["c"].append(mix(context))
    return {
        k: np.concatenate(v) if v else np.empty(0, np.uint64 if k in "hc" else np.int64)
        for k, v in out.items()
    }


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
