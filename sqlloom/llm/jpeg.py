"""Luminance of baseline JPEG frames: any Huffman and quantisation tables, sampling factors and restart intervals.

Progressive, arithmetic and 12-bit frames are refused with ValueError, as are
frames without their own Huffman tables.
"""

from __future__ import annotations

import struct

import numpy as np

#: Places of the 64 coefficients in the order in which a block stores them.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))])
#: COSINE[u, x]: the cosine transform's base functions.
COSINE = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For every 16 bits: the length of the code they begin with (0: none) and its symbol."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            span = 1 << (16 - length)
            first = code << (16 - length)
            out[first : first + span] = [(length, symbols[k])] * span
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Bits of one stretch of entropy-coded bytes between restart markers, stuffing undone."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data.replace(b"\xff\x00", b"\xff") + b"\x00" * 8, 0, 8 * (len(data) + 8)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 5], "big") >> (40 - (self.at & 7) - n)) & ((1 << n) - 1)

    def symbol(self, table: list[tuple[int, int]]) -> int:
        length, symbol = table[self.peek(16)]
        if not length or self.at > self.size:
            raise ValueError("damaged JPEG scan")
        self.at += length
        return symbol

    def signed(self, n: int) -> int:
        """n more bits as a signed difference."""
        if not n:
            return 0
        x = self.peek(n)
        self.at += n
        return x if x >> (n - 1) else x - (1 << n) + 1


def _block(bits: _Bits, dc: list, ac: list, last: int) -> tuple[list[int], int]:
    out, last = [0] * 64, last + bits.signed(bits.symbol(dc))
    out[0], k = last, 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if size:
            k += run
            if k > 63:
                raise ValueError("damaged JPEG scan")
            out[k] = bits.signed(size)
            k += 1
        elif run == 15:
            k += 16
        else:
            break
    return out, last


def luminance(frame: bytes) -> np.ndarray:
    """Samples (height, width) of the first component of a baseline frame."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, huff, parts, restart = 2, {}, {}, [], 0
    while True:
        while frame[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("damaged JPEG frame")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, k = divmod(body[0], 16)
                quant[k] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("not an 8-bit JPEG frame")
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
        elif marker == 0xDA:
            break
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline JPEG frame")
    if not parts or body[0] != len(parts):
        raise ValueError("not a frame of one interleaved scan")
    for i, p in enumerate(parts):
        tables = body[2 + 2 * i]
        if tables >> 4 not in huff or 16 | tables & 15 not in huff or p["q"] not in quant:
            raise ValueError("a JPEG frame without its tables")
        p["dc"], p["ac"] = huff[tables >> 4], huff[16 | tables & 15]
    if len(parts) == 1:
        parts[0]["h"] = parts[0]["v"] = 1  # a single component is not interleaved
    across, down = max(p["h"] for p in parts), max(p["v"] for p in parts)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    first = parts[0]
    coded = np.zeros((rows * first["v"], columns * first["h"], 64))
    # stretches between restart markers, which no stuffed byte can look like
    pieces, start = [], at
    while True:
        k = frame.find(b"\xff", at)
        if k < 0 or k + 1 >= len(frame) or not (frame[k + 1] == 0 or 0xD0 <= frame[k + 1] <= 0xD7):
            pieces.append(frame[start : k if k >= 0 else len(frame)])
            break
        at = k + 2
        if frame[k + 1]:
            pieces.append(frame[start:k])
            start = at
    bits, last, piece = _Bits(pieces[0]), [0] * len(parts), 0
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            piece += 1
            if piece >= len(pieces):
                raise ValueError("damaged JPEG scan")
            bits, last = _Bits(pieces[piece]), [0] * len(parts)
        y, x = divmod(unit, columns)
        for i, p in enumerate(parts):
            for v in range(p["v"]):
                for h in range(p["h"]):
                    block, last[i] = _block(bits, p["dc"], p["ac"], last[i])
                    if i == 0:
                        coded[y * p["v"] + v, x * p["h"] + h] = block
    flat = np.zeros_like(coded)
    flat[..., ZIGZAG] = coded * quant[first["q"]]
    pixels = np.einsum("ux,abuv,vy->axby", COSINE, flat.reshape(*coded.shape[:2], 8, 8), COSINE)
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(8 * coded.shape[0], 8 * coded.shape[1])
    # a component of fewer samples than others is as much smaller
    return pixels[: -(-height * first["v"] // down), : -(-width * first["h"] // across)]
