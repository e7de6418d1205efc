"""Monotone integer sequences in Elias-Fano form, and an n-gram trie of them in one memory-mapped file."""

from __future__ import annotations

import numpy as np

from .blocks import U64


class Writer:
    """Arrays one after the other in a file, each on a multiple of 8 bytes."""

    def __init__(self, path: str):
        self.file, self.at = open(path, "wb"), 0

    def put(self, values: np.ndarray) -> tuple[int, str, int]:
        place = (self.at, values.dtype.str, len(values))
        raw = values.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        self.file.write(raw)
        self.at += len(raw)
        return place

    def close(self) -> None:
        self.file.close()


class EliasFano:
    """A non-decreasing sequence below ``bound``: low bits as they are, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int, size: int):
        self.low, self.bits, self.size = low, bits, size
        zeros = np.flatnonzero(np.unpackbits(high, bitorder="little")[: size + self._buckets(high, size)] == 0)
        #: Elements before each value of the high bits.
        self.before = np.concatenate(([0], zeros - np.arange(len(zeros))))

    @staticmethod
    def _buckets(high: np.ndarray, size: int) -> int:
        return len(high) * 8 - size

    @staticmethod
    def write(out: Writer, values: np.ndarray, bound: int) -> dict:
        n = max(len(values), 1)
        bits = max(0, (bound // n).bit_length() - 1)
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else U64
        values = values.astype(U64)
        upper = (values >> U64(bits)).astype(np.int64)
        line = np.zeros(len(values) + (bound >> bits) + 1, np.uint8)
        line[upper + np.arange(len(values))] = 1
        low = (values & U64((1 << bits) - 1)).astype(kind)
        return {"low": out.put(low), "high": out.put(np.packbits(line, bitorder="little")), "bits": bits, "size": len(values)}

    @classmethod
    def read(cls, data: np.ndarray, form: dict) -> EliasFano:
        return cls(_view(data, form["low"]), _view(data, form["high"]), form["bits"], form["size"])

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first element that isn't smaller, and whether it is equal."""
        values = values.astype(U64)
        upper = np.minimum((values >> U64(self.bits)).astype(np.int64), len(self.before) - 2) if len(self.before) > 1 else np.zeros(len(values), np.int64)
        place = self.before[upper]
        end = self.before[np.minimum(upper + 1, len(self.before) - 1)]
        rest = (values & U64((1 << self.bits) - 1)).astype(U64)
        todo = np.flatnonzero(place < end)
        while len(todo):
            todo = todo[self.low[place[todo]].astype(U64) < rest[todo]]
            place[todo] += 1
            todo = todo[place[todo] < end[todo]]
        inside = place < end
        equal = np.zeros(len(values), bool)
        equal[inside] = self.low[place[inside]].astype(U64) == rest[inside]
        return place, equal


def _view(data: np.ndarray, place: tuple[int, str, int]) -> np.ndarray:
    at, kind, n = place
    return data[at : at + n * np.dtype(kind).itemsize].view(kind)


def quantised(values: np.ndarray) -> tuple[np.ndarray, float, float]:
    """16-bit codes of values between their smallest and largest."""
    low = float(values.min()) if len(values) else 0.0
    step = (float(values.max()) - low) / 65535 if len(values) else 0.0
    return np.round((values - low) / (step or 1.0)).astype(np.uint16), low, step


class Trie:
    """Words, the words before them, and the words before those, as levels of Elias-Fano sequences.

    A child's element is its parent's place times the width of a child key plus that key, so a level
    is one monotone sequence and a child is found by a successor search within its parent's stretch.
    Each node has quantised log10 numerators, nodes of the first two levels also denominators.
    """

    def __init__(self, path: str, widths: tuple[int, ...], levels: list[dict]):
        data = np.memmap(path, np.uint8, "r")
        self.widths = widths
        self.levels = [EliasFano.read(data, x["keys"]) for x in levels]
        self.values = [{name: (_view(data, place), low, step) for name, (place, low, step) in x["values"].items()} for x in levels]

    @staticmethod
    def write(path: str, widths: tuple[int, ...], keys: list[np.ndarray], parents: list[np.ndarray], values: list[dict[str, np.ndarray]]) -> list[dict]:
        """``widths``: bits of a key of each level; ``parents``: place of each node's parent (level 1: none)."""
        out, levels = Writer(path), []
        for k, (width, key) in enumerate(zip(widths, keys)):
            element = key.astype(U64) if k == 0 else (parents[k].astype(U64) << U64(width)) + key.astype(U64)
            bound = (1 << width) if k == 0 else max(len(keys[k - 1]), 1) << width
            form = {"keys": EliasFano.write(out, element, bound), "values": {}}
            for name, x in values[k].items():
                codes, low, step = quantised(x)
                form["values"][name] = (out.put(codes), low, step)
            levels.append(form)
        out.put(np.zeros(1, U64))  # a file that can be mapped, without a node too
        out.close()
        return levels

    def find(self, level: int, parent: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Place of the child ``key`` of each parent in a level, -1 where there is none."""
        width = U64(self.widths[level])
        element = key.astype(U64) if level == 0 else (np.maximum(parent, 0).astype(U64) << width) + key.astype(U64)
        place, equal = self.levels[level].successor(element)
        return np.where(equal & (parent >= 0), place, -1)

    def value(self, level: int, name: str, node: np.ndarray) -> np.ndarray:
        codes, low, step = self.values[level][name]
        return codes[node].astype(np.float64) * step + low
