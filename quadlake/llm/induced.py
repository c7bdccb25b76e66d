"""External induced sorting of suffixes with common-prefix values.

``sorted_suffixes`` yields the suffixes of a byte string in descending order together with their common
prefix with the suffix before, capped at `depth`. It follows the induced-sorting scheme:

1. positions are typed (S: smaller than the next suffix, L: larger); the leftmost S of each run (LMS)
   are the seeds;
2. seeds are ordered by naming the substrings between them and sorting the reduced string of names, by
   rank doubling, as deep as `depth` bytes need;
3. one ascending scan induces all L suffixes from the seeds, one descending scan all S suffixes from
   the L ones. Scanned suffixes insert their predecessors into a monotone priority queue: its key is
   (first byte, time of insertion), so it is a row of 256 first-in first-out queues. Tuples carry the
   position and the common prefix with the tuple before them in the queue: one more than the minimum over
   the common prefixes scanned since that tuple's source.

Scans work on blocks. Queues and finished L suffixes keep up to `memory` bytes and write older blocks to one
file, which is removed at the end, so only the text and the seeds are held besides: positions have 31 bits, seeds are
named without holding more than their distinct substrings, and whatever a step makes on the way is as large as a block.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterator

BLOCK = 1 << 17


class Store:
    """Blocks of (position, common prefix), in memory up to a limit and beyond it in a file."""

    def __init__(self, memory: int, folder: str | None = None):
        self.memory, self.used, self.folder = memory, 0, folder
        self.file, self.path, self.spilled = None, None, 0

    def put(self, pos, lcp):
        size = pos.nbytes + lcp.nbytes
        if self.used + size <= self.memory:
            self.used += size
            return pos.copy(), lcp.copy()  # a slice would keep all of its scanned block
        if self.file is None:
            handle, self.path = tempfile.mkstemp(prefix="suffixes-", dir=self.folder)
            self.file = os.fdopen(handle, "w+b")
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(pos.tobytes())
        self.file.write(lcp.tobytes())
        self.spilled += size
        return at, pos.size

    def get(self, block, keep: bool = False):
        import numpy as np

        if not isinstance(block[0], int):
            if not keep:
                self.used -= block[0].nbytes + block[1].nbytes
            return block
        at, n = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(4 * n), np.int32), np.frombuffer(self.file.read(2 * n), np.uint16)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)
            self.file = None


class Queue:
    """A monotone priority queue over 256 first bytes; equal keys leave in order of insertion."""

    def __init__(self, store: Store):
        self.store = store
        self.blocks = [deque() for _ in range(256)]

    def push(self, byte: int, pos, lcp) -> None:
        self.blocks[byte].append(self.store.put(pos, lcp))

    def pop(self, byte: int):
        """What has been inserted under a byte so far, up to about one block; None if nothing."""
        import numpy as np

        waiting = self.blocks[byte]
        if not waiting:
            return None
        taken, size = [], 0
        while waiting and size < BLOCK:
            taken.append(self.store.get(waiting.popleft()))
            size += taken[-1][0].size
        return taken[0] if len(taken) == 1 else (np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken]))


class Inducer:
    """Turns scanned blocks into insertions, with the common prefixes of the new tuples."""

    def __init__(self, text, kinds, queue: Queue, depth: int, want: bool):
        import numpy as np

        self.text, self.kinds, self.queue, self.depth, self.want = text, kinds, queue, depth, want
        self.since = np.full(256, depth, np.int64)  # least common prefix since a byte's last insertion
        self.fresh = np.ones(256, bool)

    def scan(self, pos, lcp) -> None:
        import numpy as np

        lcp = lcp.astype(np.int64)
        before = pos - 1
        ok = np.flatnonzero((before >= 0) & (self.kinds[before] == self.want))
        if not ok.size:
            np.minimum(self.since, lcp.min(), out=self.since)
            return
        bytes_ = self.text[before[ok]]
        order = np.argsort(bytes_, kind="stable")
        at, by = ok[order], bytes_[order].astype(np.int64)
        first = np.concatenate((np.ones(1, bool), by[1:] != by[:-1]))
        prior = np.concatenate((np.zeros(1, np.int64), at[:-1]))
        least = np.empty(at.size, np.int64)
        heads = np.minimum.accumulate(lcp)
        least[first] = np.minimum(self.since[by[first]], heads[at[first]])
        rest = ~first
        if rest.any():
            least[rest] = _range_min(lcp, prior[rest] + 1, at[rest])
        value = np.minimum(least + 1, self.depth)
        starts = np.flatnonzero(first)
        news = by[starts]
        value[starts[self.fresh[news]]] = 0
        tails = np.minimum.accumulate(lcp[::-1])[::-1]
        ends = at[np.append(starts[1:], at.size) - 1] + 1
        np.minimum(self.since, heads[-1], out=self.since)
        self.since[news] = np.where(ends < lcp.size, tails[np.minimum(ends, lcp.size - 1)], self.depth)
        self.fresh[news] = False
        value = value.astype(np.uint16)
        sources = before[at]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), at.size], strict=True):
            self.queue.push(int(by[a]), sources[a:b], value[a:b])


def _range_min(x, first, last):
    """Minima of x[first..last], inclusive, by a table of powers of two."""
    import numpy as np

    width = (last - first + 1).astype(np.int64)
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(first.size, x.dtype)
    row, step = x, 1
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        if mine.size:
            out[mine] = np.minimum(row[first[mine]], row[last[mine] - step + 1])
        if row.size <= step:
            break
        row = np.minimum(row[:-step], row[step:])
        step *= 2
    return out


def _kinds(text, depth: int):
    """True where the suffix is S: smaller than the one after it. The end of the text is smallest. And the length of the run of a byte from each position, capped."""
    import numpy as np

    n = text.size
    kinds, runs = np.empty(n, bool), np.empty(n, np.uint16)
    following, larger = n - 1, False  # the next position whose byte differs from the one after it, and whether that one is larger
    for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        b = min(a + BLOCK, n)
        step = np.zeros(b - a, np.int8)
        step[: min(b, n - 1) - a] = np.sign(text[a + 1 : b + 1].astype(np.int16) - text[a : min(b, n - 1)].astype(np.int16))
        at = np.where(step != 0, np.arange(a, b, dtype=np.int32), np.int32(n))
        at[-1] = at[-1] if step[-1] else following
        at = np.minimum.accumulate(at[::-1])[::-1]
        inside = at < b
        kinds[a:b] = np.where(inside, step[np.where(inside, at - a, 0)] > 0, larger)
        runs[a:b] = np.minimum(at - np.arange(a, b, dtype=np.int32) + 1, depth)
        following, larger = int(at[0]), bool(kinds[a])
    return kinds, runs


def _seeds(text, data: bytes, lms, depth: int):
    """LMS positions in ascending order of their suffixes, by at least `depth` bytes, and common prefixes."""
    import numpy as np

    m = lms.size
    seen: dict[bytes, int] = {}  # distinct substrings only; names in order of appearance first

    def parts() -> Iterator[bytes]:
        for a in range(0, m - 1, BLOCK):
            at = lms[a : a + BLOCK + 1].tolist()
            for i, j in zip(at[:-1], at[1:], strict=True):
                yield data[i : j + 1] + b"\xff"
        yield data[int(lms[-1]) :]

    rank = np.fromiter((seen.setdefault(p, len(seen)) for p in parts()), np.int32, m)
    names = np.empty(len(seen), np.int32)
    names[np.fromiter((seen[p] for p in sorted(seen)), np.int32, len(seen))] = np.arange(1, len(seen) + 1)
    rank, top = names[rank], len(seen)
    del seen, names
    span = 1
    while top < m and span * 2 < 2 * depth:  # a name moves on by at least two bytes
        key = rank.astype(np.int64) * (m + 1)
        key[: m - span] += rank[span:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.ones(m, bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        del key
        rank[order] = np.cumsum(fresh, dtype=np.int32)
        top, span = int(np.count_nonzero(fresh)), span * 2
        del order, fresh
    order = lms[np.argsort(rank, kind="stable")]
    return order, common_prefixes(text, order, depth)


def common_prefixes(text, order, depth: int):
    """Common prefix of each suffix with the one before, by words of eight bytes, up to `depth`; a block at a time."""
    import numpy as np

    out = np.zeros(order.size, np.uint16)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    words = np.ndarray(padded.size - 7, ">u8", padded, strides=(1,))
    for a in range(1, order.size, BLOCK):
        live = np.arange(a, min(a + BLOCK, order.size))
        done = 0
        while live.size and done < depth:
            x = words[order[live] + done] ^ words[order[live - 1] + done]
            differ = x != 0
            hit = live[differ]
            if hit.size:
                exact = np.zeros(hit.size, np.int64)
                high = x[differ].astype(np.uint64)
                for byte in range(8):  # leading equal bytes, without rounding
                    exact += (exact == byte) & ((high >> np.uint64(56 - 8 * byte)) & np.uint64(255) == 0)
                out[hit] = np.minimum(done + exact, depth)
            live = live[~differ]
            done += 8
        out[live] = depth
    room = text.size - np.maximum(order[1:], order[:-1])
    out[1:] = np.minimum(out[1:], room)  # nothing is shared beyond the end
    return out


def sorted_suffixes(data: bytes, depth: int, memory: int = 256 << 20, folder: str | None = None) -> Iterator[tuple]:
    """Blocks of (positions, common prefix with the suffix emitted before), in descending order of suffixes.

    Suffixes that agree on `depth` bytes come in any order among themselves.
    """
    import numpy as np

    n = len(data)
    if n == 0:
        return
    text = np.frombuffer(data, np.uint8)
    if n >= 1 << 31:
        raise ValueError("positions have 31 bits")
    kinds, runs = _kinds(text, depth)
    lms = (np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1).astype(np.int32)
    store = Store(memory, folder)
    try:
        if lms.size:
            seeds, shared = _seeds(text, data, lms, depth)
        else:
            seeds, shared = lms, np.zeros(0, np.uint16)
        bounds = np.searchsorted(text[seeds], np.arange(257)) if seeds.size else np.zeros(257, np.int64)
        queue = Queue(store)
        larger = [[] for _ in range(256)]
        inducer = Inducer(text, kinds, queue, depth, False)
        queue.push(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.uint16))  # from the empty suffix
        inducer.fresh[text[n - 1]] = False
        inducer.since[:] = 0
        for byte in range(256):
            last = -1
            while (block := queue.pop(byte)) is not None:
                inducer.scan(*block)
                larger[byte].append(store.put(*block))
                last = int(block[0][-1])
            for a in range(int(bounds[byte]), int(bounds[byte + 1]), BLOCK):
                b = min(a + BLOCK, int(bounds[byte + 1]))
                pos, lcp = seeds[a:b], shared[a:b].copy()
                if a == bounds[byte]:  # an S after the last L of the bucket: both start with a run of this byte
                    lcp[0] = 0 if last < 0 else min(int(runs[last]), int(runs[pos[0]]), depth)
                inducer.scan(pos, lcp)
        queue = Queue(store)
        inducer = Inducer(text, kinds, queue, depth, True)
        for byte in range(255, -1, -1):
            last = -1
            while (block := queue.pop(byte)) is not None:
                inducer.scan(*block)
                yield block
                last = int(block[0][-1])
            after = -1  # common prefix of the first L of the block above with its predecessor
            for held in reversed(larger[byte]):
                pos, lcp = store.get(held)
                back = pos[::-1]
                down = np.empty(pos.size, np.uint16)
                down[1:] = lcp[::-1][:-1]
                if after >= 0:
                    down[0] = after
                else:
                    down[0] = 0 if last < 0 else min(int(runs[last]), int(runs[back[0]]), depth)
                after = int(lcp[0])
                inducer.scan(back, down)
                yield back, down
    finally:
        store.close()
