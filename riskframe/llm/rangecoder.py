"""Adaptive context-mixing range coder for token ids, many blocks at once.

A block is a run of ids coded on its own: all state starts afresh. At each
position three predictors are mixed:

* order 2: the id that last followed the two ids before (a hashed table with a
  small confidence count),
* order 1: the same for the one id before,
* order 0: adaptive counts over classes of ids (narrow classes for low ids),
  even within a class, refreshed every ``REFRESH`` positions.

The line of probability is cut into [id = c2), [id = c1) and the order-0
distribution of the rest: q2 = p2, q1 = (1 - p2) p1 (both fall to c2 when the
predictions agree), and 1 - q2 - q1. The mixing weights p2 and p1 are adaptive
probabilities chosen by both confidences and by whether the predictions
agree. A carry-less 64-bit range coder with 16-bit output words codes first
the part of the line, then, if it is the rest, the id within order 0.
Decoding repeats the same updates.

All blocks of a batch advance in step as lanes of numpy arrays, so the cost
per id is a few array operations shared by all lanes. Ids are below 65536.
"""

from __future__ import annotations

import numpy as np

IDS = 1 << 16
SLOTS_BITS = 10
SLOTS = 1 << SLOTS_BITS
REFRESH = 128
TOTAL_BITS = 24                # order-0 shares are of 2**24
FLOOR = 16                     # least share of an id
HIT, MISS = np.int32(64000), np.int32(512)
U = np.uint64
I4 = np.int32
U16, U24, U48, TOP, BOTTOM = U(16), U(24), U(48), U(1 << 48), U(1 << 40)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Starts and log2 widths: 32 classes of 16 ids, then 16 for each doubling."""
    starts, bits, at = [], [], 0
    while at < IDS:
        b = 4 if at < 512 else at.bit_length() - 5
        starts.append(at)
        bits.append(b)
        at += 1 << b
    return np.array(starts, I4), np.array(bits, I4)


STARTS, BITS = _classes()
CLASSES = len(STARTS)
CLASS_OF = np.repeat(np.arange(CLASSES, dtype=I4), 1 << BITS)


class Lanes:
    """Predictor state of ``n`` blocks. Arrays of both orders are stacked:
    row 0 is order 2, row 1 is order 1."""

    def __init__(self, n: int):
        self.n = n
        lane = np.arange(n, dtype=np.int64)
        self.at_class = lane * CLASSES
        self.at_table = np.stack([lane, lane + n]) * SLOTS
        self.at_mix = np.stack([lane, lane + n]) * 32
        self.table = np.zeros(2 * n * SLOTS, np.uint32)      # id * 4 + confidence
        # adaptive probabilities of 16 bits, by (own confidence, the other's, agreement)
        self.mix = np.tile(np.repeat(np.array([0, 8, 20, 36], I4) * 1024, 8), 2 * n)
        weight = np.log((STARTS + (1 << BITS) + 8.0) / (STARTS + 8.0))
        self.counts = np.tile((weight / weight.sum() * 32).astype(np.float32), (n, 1))
        self.flat_counts = self.counts.reshape(-1)
        self.hash = np.zeros((2, n), np.int64)               # of the context of each order
        self.step = 0
        self.refresh()

    def refresh(self) -> None:
        """Each class's share of an id and its start, from the counts."""
        free = (1 << TOTAL_BITS) - FLOOR * IDS
        scale = np.float32(free) / self.counts.sum(1, keepdims=True)
        each = (self.counts * scale * np.float32(0.999)).astype(I4) >> BITS
        each += FLOOR
        start = np.cumsum(each << BITS, axis=1, dtype=I4)
        start -= each << BITS
        self.each, self.start = each.reshape(-1), start.reshape(-1)
        # one ascending line for all lanes, so that one search serves them
        self.line = (start + (self.at_class // CLASSES << TOTAL_BITS + 1)[:, None]).reshape(-1)

    def predict(self) -> None:
        """Candidates c2, c1 and the ends q2 <= q12 of their parts, of 2**16."""
        self.slot = self.at_table + (self.hash & (SLOTS - 1))
        self.entry = entry = self.table[self.slot]
        self.c = c = entry >> 2
        self.f = f = entry & 3
        agree = c[0] == c[1]
        self.j = self.at_mix + (f << 3) + (f[::-1] << 1) + agree
        self.v = v = self.mix[self.j]
        q2, q1 = np.where(f, v, 0)
        # halves keep the product within 31 bits
        q12 = q2 + ((65536 - q2 >> 1) * q1 >> 15)
        self.q2, self.q12 = np.where(agree, q12, q2).astype(U), q12.astype(U)

    def update(self, ids: np.ndarray, missed: np.ndarray) -> None:
        hit, f, v = self.c == ids, self.f, self.v
        self.mix[self.j] = v + ((np.where(hit, HIT, MISS) - v) >> 4)
        new = (ids << 2) + 1
        self.table[self.slot] = np.where(hit, self.entry + (f < 3), np.where(f > 1, self.entry - f + 1, new))
        self.flat_counts[self.at_class[missed] + CLASS_OF[ids[missed]]] += 1
        one = self.hash[1]
        self.hash[0] = one << 2
        one[:] = ids
        one *= 40503
        one >>= 2
        self.hash[0] ^= one >> 3
        self.step += 1
        if self.step % REFRESH == 0 or self.step in (16, 32, 64):
            self.refresh()


def _room(low: np.ndarray, width: np.ndarray):
    """Lanes whose top 16 bits can go: settled, or cut where the range is narrow."""
    settled = (low ^ (low + width)) < TOP
    move = settled | (width < BOTTOM)
    at = np.flatnonzero(move)
    if len(at):
        tight = at[~settled[at]]
        if len(tight):
            width[tight] = (U(0) - low[tight]) & (BOTTOM - U(1))
    return at


def encode(blocks: np.ndarray) -> list[bytes]:
    """Code the rows of a (blocks, positions) array; one payload per row."""
    n, length = blocks.shape
    lanes, columns = Lanes(n), np.ascontiguousarray(blocks.T).astype(np.uint32)
    low, width = np.zeros(n, U), np.full(n, np.iinfo(np.uint64).max, U)
    room = 2 * length + 8
    out, fill = np.zeros(n * room, np.uint16), np.arange(n, dtype=np.int64) * room
    begin = fill.copy()
    for ids in columns:
        lanes.predict()
        is2 = lanes.c[0] == ids
        is2 &= lanes.q2 > 0
        is1 = (lanes.c[1] == ids) & (lanes.q12 > lanes.q2) & ~is2
        start = np.where(is2, U(0), np.where(is1, lanes.q2, lanes.q12))
        end = np.where(is2, lanes.q2, np.where(is1, lanes.q12, U(65536)))
        unit = width >> U16
        low += unit * start
        width = unit * (end - start)
        missed = np.flatnonzero(~(is2 | is1))
        some = ids[missed]
        c = CLASS_OF[some]
        at = lanes.at_class[missed] + c
        each = lanes.each[at]
        unit = width[missed] >> U24
        low[missed] += unit * (lanes.start[at] + each * (some - STARTS[c])).astype(U)
        width[missed] = unit * each.astype(U)
        while len(at := _room(low, width)):
            out[fill[at]] = low[at] >> U48
            fill[at] += 1
            low[at] <<= U16
            width[at] <<= U16
        lanes.update(ids, missed)
    for _ in range(4):
        out[fill] = low >> U48
        fill += 1
        low <<= U16
    return [out[a:b].astype("<u2").tobytes() for a, b in zip(begin, fill)]


def decode(payloads: list[bytes], length: int) -> np.ndarray:
    """The first ``length`` ids of every payload, as rows."""
    n = len(payloads)
    room = max(len(p) for p in payloads) // 2 + 8
    data = np.zeros(n * room, U)
    for i, p in enumerate(payloads):
        data[i * room:i * room + len(p) // 2] = np.frombuffer(p, "<u2")
    lanes, out = Lanes(n), np.empty((length, n), np.uint32)
    width = np.full(n, np.iinfo(np.uint64).max, U)
    low, code, fill = np.zeros(n, U), np.zeros(n, U), np.arange(n, dtype=np.int64) * room
    last = fill + room - 1
    for _ in range(4):
        code = (code << U16) | data[fill]
        fill += 1
    for t in range(length):
        lanes.predict()
        unit = width >> U16
        x = code - low
        not2, not1 = x >= unit * lanes.q2, x >= unit * lanes.q12
        start = np.where(not2, np.where(not1, lanes.q12, lanes.q2), U(0))
        end = np.where(not2, np.where(not1, U(65536), lanes.q12), lanes.q2)
        ids = np.where(not2, lanes.c[1], lanes.c[0])
        low += unit * start
        width = unit * (end - start)
        missed = np.flatnonzero(not1)
        unit = width[missed] >> U24
        y = np.minimum((code[missed] - low[missed]) // unit, U((1 << TOTAL_BITS) - 1)).astype(np.int64)
        at = np.searchsorted(lanes.line, y + (missed << TOTAL_BITS + 1), side="right") - 1
        c = at - lanes.at_class[missed]
        each, first = lanes.each[at], lanes.start[at]
        off = np.minimum(((y - first) / each).astype(I4), (1 << BITS[c]) - 1)
        ids[missed] = STARTS[c] + off
        low[missed] += unit * (first + each * off).astype(U)
        width[missed] = unit * each.astype(U)
        while len(at := _room(low, width)):
            code[at] = (code[at] << U16) | data[np.minimum(fill[at], last[at])]
            fill[at] += 1
            low[at] <<= U16
            width[at] <<= U16
        out[t] = ids
        lanes.update(ids, missed)
    return out.T
