"""FNV-1a hashes of short texts, on the driver."""

from __future__ import annotations


def _fnv1a(data: bytes, basis: int, prime: int, bits: int) -> int:
    h = basis
    for b in data:
        h = (h ^ b) * prime & ((1 << bits) - 1)
    return h


def fnv1a64(text: str) -> str:
    """64 bits, as 16 hex digits."""
    return f"{_fnv1a(text.encode(), 0xCBF29CE484222325, 0x100000001B3, 64):016x}"


def fnv1a32(text: str) -> int:
    return _fnv1a(text.encode(), 0x811C9DC5, 0x01000193, 32)


def jitter(text: str) -> float:
    """A number from -1 to 1 that depends on the text alone."""
    return fnv1a32(text) / 0xFFFFFFFF * 2 - 1


def color_index(text: str, colors: int) -> int:
    """One of so many colors, from the hash as a signed number."""
    h = fnv1a32(text)
    return abs(h - (1 << 32) if h >= 1 << 31 else h) % colors
