"""Edit distance of many pairs of texts at once: bit-parallel (Myers), in a band along the diagonal (Hyyrö)."""

from __future__ import annotations

import numpy as np

#: Pairs that go through the columns together, and columns between two clearings of decided pairs.
PAIRS, CLEARED = 1024, 64
#: Bands of more 64-bit words, and fewer pairs, are not worth a batch.
WIDE, FEW = 16, 24


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def edit_within(first: list[np.ndarray], second: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Whether the edit distance (insert, delete, replace) of first[k] and second[k], code points, is at most limit[k]."""
    limit = np.asarray(limit, dtype=np.int64)
    first, second = zip(*map(_between, first, second)) if len(first) else ((), ())
    # what is left of the longer text can be replaced
    out = np.fromiter((max(len(x), len(y)) for x, y in zip(first, second)), dtype=np.int64, count=len(first)) <= limit
    swap = [len(x) < len(y) for x, y in zip(first, second)]
    long = [y if s else x for s, x, y in zip(swap, first, second)]
    short = [x if s else y for s, x, y in zip(swap, first, second)]
    n = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
    more = np.fromiter(map(len, long), dtype=np.int64, count=len(long)) - n
    # a path of at most `limit` edits strays at most (limit - more) // 2 from between the two corners' diagonals
    words = limit // 64 + 1
    todo = np.flatnonzero(~out & (more <= limit))
    todo = todo[np.lexsort((n[todo], words[todo]))]
    at = 0
    while at < len(todo):
        w = words[todo[at]]
        same = int(np.searchsorted(words[todo], w, side="right"))
        part = todo[at : min(at + PAIRS, same)]
        if w > WIDE or len(part) < FEW:
            # a whole column in one large number
            out[part] = [_one(long[k], short[k], int(limit[k])) for k in part]
        else:
            out[part] = _banded([long[k] for k in part], [short[k] for k in part], n[part], more[part], limit[part], int(w))
        at += len(part)
    return out


def _banded(long: list[np.ndarray], short: list[np.ndarray], n: np.ndarray, more: np.ndarray, limit: np.ndarray, words: int) -> np.ndarray:
    """Pairs sorted by n, the length of the shorter text, whose limit is below 64 * words.

    Bit p of a pair's window stands, in column j, for row j + low - top + p of
    the table of distances: the window goes down the diagonal. The distance is
    followed along the diagonal that ends in the last corner; it never falls.
    """
    top, one = 64 * words - 1, np.uint64(1)
    stray = (limit - more) // 2
    lead = top - more - stray
    width = int(n[-1]) + top + 1
    # the narrowest numbers that hold all code points and two that no text has
    most = max((int(x.max()) for x in (*long, *short) if len(x)), default=0)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if most < np.iinfo(t).max - 1)
    a = np.full((len(long), width), np.iinfo(kind).max, dtype=kind)
    b = np.full((len(long), int(n[-1])), np.iinfo(kind).max - 1, dtype=kind)
    for k, (x, y) in enumerate(zip(long, short)):
        x = x[: width - lead[k]]
        a[k, lead[k] : lead[k] + len(x)] = x
        b[k, : len(y)] = y
    b = np.ascontiguousarray(b.T)
    bit = np.arange(64 * words)
    plus = np.packbits(bit >= lead[:, None], axis=1, bitorder="little").view("<u8").T.copy()
    minus = np.zeros_like(plus)
    watched = top - stray
    word, shift = watched // 64, (watched % 64).astype(np.uint64)
    every = np.arange(len(long))
    distance, out = more.copy(), np.zeros(len(long), dtype=bool)
    who, ended = np.arange(len(long)), 0
    for j in range(int(n[-1])):
        ended = int(np.searchsorted(n[who], j, side="right"))
        if j % CLEARED == 0 and j:
            out[who[:ended]] = distance[:ended] <= limit[who[:ended]]
            live = np.flatnonzero(distance[ended:] <= limit[who[ended:]]) + ended
            who, distance, word, shift = who[live], distance[live], word[live], shift[live]
            a, b, plus, minus, ended = a[live], b[:, live], plus[:, live], minus[:, live], 0
            if not len(who):
                return out
        same = np.packbits((a[:, j : j + top + 1] == b[j][:, None]).reshape(-1), bitorder="little").view("<u8").reshape(len(who), words).T
        total = (same & plus) + plus
        over = total < plus
        for w in range(1, words):
            total[w] += over[w - 1]
            over[w] |= over[w - 1] & (total[w] == 0)
        zero = (total ^ plus) | same | minus
        up, down = minus | ~(zero | plus), zero & plus
        step = one - ((zero[word, every[: len(who)]] >> shift) & one)
        distance[ended:] += step[ended:].astype(np.int64)
        lower = zero >> one
        if words > 1:
            lower[:-1] |= zero[1:] << np.uint64(63)
        plus, minus = down | ~(lower | up), lower & up
    out[who] = distance <= limit[who]
    return out


def _between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two texts without their equal heads and tails; no fewest edits are in those."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    head = int(differ.argmax()) if n else 0
    if n and not differ[head]:
        head = n
    a, b, n = a[head:], b[head:], n - head
    differ = (a[len(a) - n :] != b[len(b) - n :])[::-1]
    tail = int(differ.argmax()) if n else 0
    if n and not differ[tail]:
        tail = n
    return a[: len(a) - tail], b[: len(b) - tail]


def _one(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """The same for one pair, without a band."""
    a, b = a.tolist(), b.tolist()
    if not a or not b:
        return max(len(a), len(b)) <= limit
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, distance = full, 0, len(a)
    for j, y in enumerate(b):
        match = where.get(y, 0)
        cross = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(cross | plus) & full, plus & cross
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance - (len(b) - 1 - j) > limit:
            return False
        up, down = (up << 1 | 1) & full, down << 1 & full
        match |= minus
        plus, minus = down | ~(match | up) & full, up & match
    return distance <= limit
