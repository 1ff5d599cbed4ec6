"""Adaptive context-mixing range coder for token ids.

A block holds up to 2**20 ids and is decoded without any other block: all statistics start
anew and a CRC-32 covers ids and lengths. Inside a block the ids are dealt to up to MAX_LANES
lanes (consecutive stretches) that move one id at a time in step, each with a range coder of its
own, so that NumPy codes a step of all lanes at once. The lanes share the block's statistics.

For each id the order-2 and order-1 contexts each predict one id, with a confidence from 0 to
7; order 0 gives a frequency for every id. The mix of the three is adaptive: for each pair of
confidences the coder counts how often order 2 was right, order 1 was right, or neither, and
codes which it is; only then is the id coded by its order-0 frequency. Decoder and encoder
make the same updates in the same order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"GTB2"
BLOCK_IDS = 1 << 20
LANE_BITS = 12
MAX_LANES, LANE_IDS = 1 << LANE_BITS, 256
#: Bits of the cumulative frequencies of an id and of a predictor.
ID_BITS, MIX_BITS = 22, 16
HASH_BITS = 18
U = np.uint64
#: A lane whose range falls below this sends a word of 32 bits.
_LEAST, _WORD = U(1 << 32), U(32)


def lane_count(n: int) -> int:
    return int(max(1, min(MAX_LANES, n // LANE_IDS)))


class Model:
    """Statistics that encoder and decoder share; updated once per step or at refreshes."""

    def __init__(self, vocabulary: int, lanes: int) -> None:
        self.vocabulary, self.lanes = vocabulary, lanes
        # cells of order 2, then of order 1: predicted id times 8 plus its confidence
        self.cells = np.zeros((1 << HASH_BITS) + vocabulary, np.int32)
        self.at = np.zeros(2 * lanes, np.int64)
        self.counts = np.zeros(vocabulary, np.int64)
        self.mix_counts = np.tile(np.array([4, 2, 4], np.int64), (128, 1))
        self.seen: list[np.ndarray] = []
        self.mixed: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        """Bring frequencies up to date with all ids coded so far."""
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.vocabulary)
            found = np.bincount(np.concatenate(self.mixed), minlength=512)
            self.mix_counts += found.reshape(128, 4)[:, :3]
            self.seen, self.mixed = [], []
        room = (1 << ID_BITS) - self.vocabulary
        share = self.counts * room // max(1, int(self.counts.sum())) + 1
        share[int(np.argmax(share))] += (1 << ID_BITS) - int(share.sum())
        self.cumulative = np.concatenate([[0], np.cumsum(share)]).astype(U)
        self.share = share.astype(U)
        room = (1 << MIX_BITS) - 3
        weights = self.mix_counts * room // self.mix_counts.sum(axis=1, keepdims=True) + 1
        weights[:, 2] += (1 << MIX_BITS) - weights.sum(axis=1)
        # four entries for each pair of confidences: starts and sizes by which is right
        starts, sizes = np.zeros((128, 4), U), np.ones((128, 4), U)
        sizes[:, :3] = weights
        starts[:, 1:] = np.cumsum(weights, axis=1)
        self.mix_start, self.mix_size = starts.ravel(), sizes.ravel()

    def at_slots(self, slots: np.ndarray) -> np.ndarray:
        """The ids that hold these places; they are searched in ascending order, which is faster."""
        keys = (slots << U(LANE_BITS)) | np.arange(len(slots), dtype=U)
        keys.sort()
        found = np.empty(len(slots), np.int64)
        place = (keys & U((1 << LANE_BITS) - 1)).astype(np.int64)
        found[place] = self.cumulative.searchsorted(keys >> U(LANE_BITS), side="right") - 1
        return found

    def predict(self, before2: np.ndarray, before1: np.ndarray) -> None:
        """Guesses of both orders for each lane, and four times the pair of their confidences."""
        n = self.lanes
        mixed = before2 * 0x43B79937 + before1 * 0x2A5B3F1D
        np.right_shift(mixed & 0xFFFFFFFF, 32 - HASH_BITS, out=self.at[:n])
        np.add(before1, 1 << HASH_BITS, out=self.at[n:])
        self.cell = self.cells.take(self.at, mode="clip")
        self.level = self.cell & 7
        self.guess = self.cell >> 3
        self.guess2, self.guess1 = self.guess[:n], self.guess[n:]
        same = self.guess1 == self.guess2
        self.state = self.level[:n] * 64 + (self.level[n:] * 8 + same * 4)

    def update(self, ids: np.ndarray, mixed: np.ndarray) -> None:
        """Take in the ids of a step; `mixed` is `state` plus which guess was right."""
        twice = np.tile(ids.astype(np.int32), 2)
        right = self.guess == twice
        # a wrong guess halves its confidence; without any it gives way to the id
        moved = self.cell + _MOVE.take(self.level * 2 + right, mode="clip")
        self.cells[self.at] = np.where(right | (self.level > 0), moved, twice << 3)
        self.seen.append(ids)
        self.mixed.append(mixed)


#: What a confidence changes by: wrong and right for each of its levels.
_MOVE = np.array([(k // 2 - k, int(k < 7)) for k in range(8)], np.int32).ravel()


def _refresh_at(step: int) -> bool:
    return step % 32 == 0 or step & (step - 1) == 0


class _Encoder:
    """One range coder for each lane. A carry goes into the lane's last word; at the end those
    that overflow pass it on."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, U)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
        self.lane: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.carry: list[np.ndarray] = []
        # place of each lane's last word among all that were sent
        self.sent, self.last = 0, np.zeros(lanes, np.int64)

    def _send(self, lane: np.ndarray, word: np.ndarray) -> None:
        self.lane.append(lane)
        self.word.append(word)
        self.last[lane] = np.arange(self.sent, self.sent + len(lane))
        self.sent += len(lane)

    def put(self, at: np.ndarray | None, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Code for the lanes `at` (None: all) a symbol that takes `size` of 2**bits from `start`."""
        before = self.low if at is None else self.low[at]
        width = (self.range if at is None else self.range[at]) >> U(bits)
        low = before + width * start
        width *= size
        carried = (low < before).nonzero()[0]
        if len(carried):
            self.carry.append(self.last[carried if at is None else at[carried]])
        move = (width < _LEAST).nonzero()[0]
        if len(move):
            now = low[move]
            self._send(move if at is None else at[move], now >> _WORD)
            low[move] = now << _WORD
            width[move] <<= _WORD
        if at is None:
            self.low, self.range = low, width
        else:
            self.low[at], self.range[at] = low, width

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of all lanes one after the other, and their number for each lane."""
        # one word, the next above `low`, is enough where all that begin with it are in range
        narrow = self.range < _LEAST << U(1)
        last = self.low + np.where(narrow, U(0), _LEAST - U(1))
        self.carry.append(self.last[last < self.low])
        self._send(np.arange(len(last)), last >> _WORD)
        narrow = narrow.nonzero()[0]
        self._send(narrow, last[narrow] & (_LEAST - U(1)))
        words = np.concatenate(self.word)
        np.add.at(words, np.concatenate(self.carry), U(1))
        lane = np.concatenate(self.lane).astype(np.uint16)
        words = words[np.argsort(lane, kind="stable")]
        over = (words >= _LEAST).nonzero()[0]
        while len(over):
            words[over] -= _LEAST
            words[over - 1] += U(1)
            over = over[words[over - 1] >= _LEAST] - 1
        return words.astype("<u4"), np.bincount(lane, minlength=len(self.low))


class _Decoder:
    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        # the word behind a lane's last one is read, but changes nothing
        self.words = np.concatenate([words.astype(U), np.zeros(2, U)])
        self.next = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[:-1]]).astype(np.int64)
        self.range = np.full(len(sizes), 0xFFFFFFFFFFFFFFFF, U)
        self.code = (self.words[self.next] << _WORD) | self.words[self.next + 1]
        self.next += 2

    def slot(self, at: np.ndarray | None, bits: int) -> np.ndarray:
        """Where the code of each lane of `at` (None: all) falls, from 0 to 2**bits - 1."""
        self.old = self.code if at is None else self.code[at]
        self.part = (self.range if at is None else self.range[at]) >> U(bits)
        return np.minimum(self.old // self.part, U((1 << bits) - 1))

    def take(self, at: np.ndarray | None, start: np.ndarray, size: np.ndarray) -> None:
        """Go on behind the symbol that slot() met."""
        code, width = self.old - self.part * start, self.part * size
        move = (width < _LEAST).nonzero()[0]
        if len(move):
            lane = move if at is None else at[move]
            to = self.next[lane]
            code[move] = (code[move] << _WORD) | self.words[to]
            self.next[lane] = to + 1
            width[move] <<= _WORD
        if at is None:
            self.code, self.range = code, width
        else:
            self.code[at], self.range[at] = code, width


def _grid(n: int, lanes: int) -> int:
    return -(-n // lanes)


def encode_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One block of documents' ids, back to back, with the number of ids of each document."""
    ids = np.ascontiguousarray(ids, "<u4")
    lanes = lane_count(len(ids))
    steps = _grid(len(ids), lanes)
    vocabulary = int(ids.max()) + 1 if len(ids) else 1
    model, out = Model(vocabulary, lanes), _Encoder(lanes)
    padded = np.zeros(steps * lanes, np.uint32)
    padded[: len(ids)] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    before2 = before1 = np.zeros(lanes, np.int64)
    for step in range(steps):
        if step and _refresh_at(step):
            model.refresh()
        now = grid[step].astype(np.int64)
        model.predict(before2, before1)
        wrong2 = now != model.guess2
        missed = wrong2 & (now != model.guess1)
        mixed = model.state + wrong2 + missed
        out.put(None, model.mix_start.take(mixed, mode="clip"), model.mix_size.take(mixed, mode="clip"), MIX_BITS)
        miss = missed.nonzero()[0]
        if len(miss):
            found = now[miss]
            out.put(miss, model.cumulative.take(found, mode="clip"), model.share.take(found, mode="clip"), ID_BITS)
        model.update(now, mixed)
        before2, before1 = before1, now
    words, sizes = out.finish()
    lengths = np.ascontiguousarray(lengths, "<u4")
    body = lengths.tobytes() + sizes.astype("<u2").tobytes() + words.tobytes()
    check = zlib.crc32(ids.tobytes(), zlib.crc32(lengths.tobytes()))
    head = struct.pack("<4sIIIII", MAGIC, len(lengths), len(ids), vocabulary, lanes, check)
    return head + body


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids (unsigned 32 bits) and lengths of a block; raises ValueError if it is damaged."""
    size = struct.calcsize("<4sIIIII")
    try:
        magic, documents, n, vocabulary, lanes, check = struct.unpack("<4sIIIII", block[:size])
        if magic != MAGIC or lanes != lane_count(n) or vocabulary > 1 << (ID_BITS - 1):
            raise ValueError("not a token block")
        lengths = np.frombuffer(block, "<u4", documents, size)
        sizes = np.frombuffer(block, "<u2", lanes, size + 4 * documents)
        words = np.frombuffer(block, "<u4", int(sizes.sum()), size + 4 * documents + 2 * lanes)
        steps = _grid(n, lanes)
        model, source = Model(vocabulary, lanes), _Decoder(words, sizes)
        grid = np.zeros((steps, lanes), np.int64)
        before2 = before1 = np.zeros(lanes, np.int64)
        for step in range(steps):
            if step and _refresh_at(step):
                model.refresh()
            model.predict(before2, before1)
            slot, state = source.slot(None, MIX_BITS), model.state
            wrong2 = slot >= model.mix_start.take(state + 1, mode="clip")
            missed = slot >= model.mix_start.take(state + 2, mode="clip")
            mixed = state + wrong2 + missed
            source.take(None, model.mix_start.take(mixed, mode="clip"), model.mix_size.take(mixed, mode="clip"))
            now = grid[step]
            now[:] = np.where(wrong2, model.guess1, model.guess2)
            miss = missed.nonzero()[0]
            if len(miss):
                slot = source.slot(miss, ID_BITS)
                found = model.at_slots(slot)
                source.take(miss, model.cumulative.take(found, mode="clip"), model.share.take(found, mode="clip"))
                now[miss] = found
            model.update(now, mixed)
            before2, before1 = before1, now
    except (struct.error, IndexError) as error:
        raise ValueError("damaged token block") from error
    ids = np.ascontiguousarray(grid.T).ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes(), zlib.crc32(lengths.tobytes())) != check:
        raise ValueError("checksum of a token block does not match")
    return ids, lengths
