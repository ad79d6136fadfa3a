"""Elias-Fano sequences and a two-level n-gram trie over them, kept in a memory-mapped file."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U64 = np.uint64
SAMPLE = 256
CHUNK = 1 << 16
CODE_SCALE = 2048  # steps per factor of ten in a quantised probability


class MappedArrays:
    """Arrays written once to an unnamed scratch file of this task and read back as a memory map."""

    def __init__(self):
        self.file, self.size, self.map = tempfile.TemporaryFile(), 0, None  # noqa: SIM115

    def put(self, array: np.ndarray) -> tuple[int, int, np.dtype]:
        place = (self.size, len(array), array.dtype)
        data = array.tobytes()
        data += b"\0" * (-len(data) % 8)
        self.file.write(data)
        self.size += len(data)
        return place

    def get(self, place: tuple[int, int, np.dtype]) -> np.ndarray:
        start, n, dtype = place
        if not n:
            return np.zeros(0, dtype)
        if self.map is None or len(self.map) < self.size:  # also after later writes
            self.file.flush()
            self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        return np.frombuffer(self.map, dtype, n, start)

    def close(self) -> None:
        self.file.close()  # the map goes with its last view


class EliasFano:
    """A non-decreasing sequence: low bits in an array, high bits as a unary bit vector with samples."""

    def __init__(self, store: MappedArrays, values: np.ndarray):
        values = values.astype(U64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, ((top + 1) // max(1, self.n)).bit_length() - 1)
        places = (values >> U64(self.low_bits)) + np.arange(self.n, dtype=U64)
        bits = np.zeros((int(places[-1]) // 8 + 1) * 8 if self.n else 0, np.uint8)
        bits[places.astype(np.int64)] = 1
        width = next(w for w in (1, 2, 4, 8) if 8 * w >= self.low_bits)
        low = (values & U64((1 << self.low_bits) - 1)).astype(f"u{width}")
        self.store = store
        self.low, self.high = store.put(low), store.put(np.packbits(bits, bitorder="little"))
        self.samples = store.put(places[::SAMPLE])

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values start .. stop - 1, decoding only their part of the bit vector."""
        if stop <= start:
            return np.zeros(0, U64)
        samples, high = self.store.get(self.samples), self.store.get(self.high)
        first = start // SAMPLE
        byte = int(samples[first]) // 8
        after = (stop - 1) // SAMPLE + 1
        last = int(samples[after]) // 8 + 1 if after < len(samples) else len(high)
        ones = np.flatnonzero(np.unpackbits(high[byte:last], bitorder="little")) + byte * 8
        skip = int(np.searchsorted(ones, int(samples[first]))) + start - first * SAMPLE
        ones = ones[skip : skip + stop - start].astype(U64)
        upper = (ones - np.arange(start, stop, dtype=U64)) << U64(self.low_bits)
        return upper | self.store.get(self.low)[start:stop].astype(U64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each of the sorted, distinct ``wanted`` values, or -1: successor search by chunks."""
        found = np.full(len(wanted), -1, np.int64)
        at = 0
        for start in range(0, self.n, CHUNK):
            values = self.slice(start, min(self.n, start + CHUNK))
            end = int(np.searchsorted(wanted, values[-1], side="right"))
            place = np.searchsorted(values, wanted[at:end])
            hit = values[np.minimum(place, len(values) - 1)] == wanted[at:end]
            found[at:end][hit] = place[hit] + start
            at = end
        return found


class Trie:
    """Contexts (level 1) with monotone pointers to their successors (level 2) and coded probabilities.

    A successor is stored relative to its context, as rank of the context * universe + id, so that the
    whole level is one monotone sequence.
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, codes: np.ndarray, universe: int):
        """Distinct (context, successor) pairs, sorted; one code each."""
        self.store = MappedArrays()
        names, first = np.unique(context, return_index=True)
        self.universe = universe
        self.contexts = EliasFano(self.store, names)
        self.pointers = EliasFano(self.store, np.append(first, len(context)))
        rank = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(context))))
        self.successors = EliasFano(self.store, rank.astype(U64) * U64(universe) + successor.astype(U64))
        self.codes = self.store.put(codes.astype(np.uint16))

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of each of the sorted, distinct pairs, or -1."""
        found = np.full(len(context), -1, np.int64)
        if not len(context):
            return found
        names, first = np.unique(context, return_index=True)
        rank = np.repeat(self.contexts.find(names.astype(U64)), np.diff(np.append(first, len(context))))
        known = np.flatnonzero(rank >= 0)
        codes = self.store.get(self.codes)
        pointers = self.pointers.slice(0, self.pointers.n).astype(np.int64)
        at = 0
        while at < len(known):
            low = int(pointers[rank[known[at]]])
            # contexts whose successors start within the chunk, the first one always
            last = max(int(np.searchsorted(pointers, low + CHUNK, side="right")) - 2, int(rank[known[at]]))
            end = at + int(np.searchsorted(rank[known[at:]], last, side="right"))
            part = known[at:end]
            values = self.successors.slice(low, int(pointers[last + 1]))
            wanted = rank[part].astype(U64) * U64(self.universe) + successor[part].astype(U64)
            place = np.searchsorted(values, wanted)
            hit = values[np.minimum(place, len(values) - 1)] == wanted
            found[part[hit]] = codes[low + place[hit]]
            at = end
        return found

    def close(self) -> None:
        self.store.close()
