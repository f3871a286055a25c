"""Two-stage suffix sorting and adjacent common prefixes, over a few hundred kilobytes at a time."""

from __future__ import annotations

import numpy as np


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts at the next byte (the end counts as smallest)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int16)))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def closed(text: np.ndarray, wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """``wanted`` and, after each wanted suffix that is larger than its successor, the run up to the next smaller one."""
    n = len(text)
    stop = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(edge, at, 1)
    np.add.at(edge, stop[at] + 1, -1)
    return np.cumsum(edge[:n]) > 0


def two_stage(data: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``data`` (of the ``wanted`` places, and some others) in an order that is right up to ``depth`` bytes.

    Only suffixes smaller than their successors are sorted by comparison, two first bytes at a time.
    A scan over the buckets of first bytes, from the smallest, then puts each other suffix in its
    place: it follows from the place of its successor, which the scan has met before.
    """
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(text)
    active = np.ones(n, bool) if wanted is None else closed(text, wanted, small)
    small = np.flatnonzero(small & active)
    pair = text[small].astype(np.int32) << 8 | np.append(text, np.uint8(0))[small + 1]
    order = np.argsort(pair, kind="stable")
    small, pair = small[order], pair[order]
    direct: list[list[int]] = [[] for _ in range(256)]
    for bucket in np.split(small, np.flatnonzero(np.diff(pair)) + 1) if len(small) else ():
        direct[text[bucket[0]]] += sorted(bucket.tolist(), key=lambda i: data[i : i + depth])
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if active[-1]:
        queue[text[-1]].append(np.array([n - 1]))  # its successor is the end, the smallest of all
    before = np.concatenate([[False], active[:-1]])  # whether the suffix one place earlier is to be placed
    out = []
    for byte in range(256):
        wave = np.concatenate(queue[byte]) if queue[byte] else np.zeros(0, np.int64)
        induced = [wave]
        while len(wave):  # runs of one byte: each suffix places the one before it in the same bucket
            prior = wave[before[wave]] - 1
            wave = prior[text[prior] == byte]
            induced.append(wave)
        bucket = np.concatenate([*induced, np.array(direct[byte], np.int64)]).astype(np.int64)
        if not len(bucket):
            continue
        out.append(bucket)
        prior = bucket[before[bucket]] - 1
        prior = prior[text[prior] > byte]
        if len(prior):
            kind = text[prior]
            order = np.argsort(kind, kind="stable")
            prior, kind = prior[order], kind[order]
            for part in np.split(prior, np.flatnonzero(np.diff(kind)) + 1):
                queue[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def adjacent_prefixes(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, ``depth`` at most; the first is 0."""
    words = np.frombuffer(data + bytes(depth + 16), np.uint8).astype(np.uint64)
    for size in (1, 2, 4):
        words = words[:-size] << np.uint64(8 * size) | words[size:]
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for done in range(0, depth, 8):
        left, right = order[live - 1] + done, order[live] + done
        differ = words[left] ^ words[right]
        same = differ == 0
        rest = differ[~same]
        equal = sum((rest < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8)) if len(rest) else 0
        out[live[~same]] = done + equal
        live = live[same]
        if not len(live):
            break
    out[live] = depth
    inside = np.minimum(len(data) - order, np.append(len(data), len(data) - order[:-1]))
    return np.minimum(np.minimum(out, inside), depth)
