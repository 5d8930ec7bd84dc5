"""Motion-JPEG in AVI: frames of 24 x 24 grey samples, each a lossless JPEG, with RIFF chunks and an index.

Lossless JPEG (the standard's process 14, prediction from the left) gives back every 8-bit sample. The writer's Huffman
table gives the category of s further bits a code of 9 - s bits, so every sample takes 9 bits. The reader takes any table:
it decodes many frames side by side, one sample of each at a time. Baseline JPEG (Huffman-coded cosine transforms), the form
that cameras write, is read too, for its first component, the brightness.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Sequence

import numpy as np

SIDE = 24
SAMPLES = SIDE * SIDE
RATE = 25


def category(difference: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(difference) + 1.0)).astype(np.int64)


#: Code word of each difference from -255 to 255: ones, a zero, then the category's bits.
_D = np.arange(-255, 256)
_S = category(_D)
WORDS = ((((1 << (8 - _S)) - 1) << (_S + 1)) | np.where(_D > 0, _D, _D + (1 << _S) - 1)).astype(">u2")
_HEADER = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)


#: Frames that are encoded or decoded at once; bounds memory for long files.
TOGETHER = 2048


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG of each frame of samples (frames, SIDE, SIDE)."""
    if len(samples) > TOGETHER:
        return [f for at in range(0, len(samples), TOGETHER) for f in encode_frames(samples[at : at + TOGETHER])]
    x = samples.astype(np.int64)
    before = np.empty_like(x)
    before[:, :, 1:] = x[:, :, :-1]
    before[:, 1:, 0] = x[:, :-1, 0]
    before[:, 0, 0] = 128
    words = WORDS[(x - before + 255).reshape(len(x), -1)]
    bits = np.unpackbits(words.view(np.uint8).reshape(len(x), SAMPLES, 2), axis=2)[:, :, 7:]
    packed = np.packbits(bits.reshape(len(x), -1), axis=1)
    return [_HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]


def parse_frame(frame: bytes) -> tuple[dict, bytes]:
    """What a JPEG's segments say, and its entropy-coded bytes: sof (marker), height, width, components [(id, h, v, quantization)],
    huffman and quantizers by their numbers, restart, scan [(id, table numbers)], predictor."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, found = 2, {"sof": None, "huffman": {}, "quantizers": {}, "restart": 0}
    while at + 4 <= len(frame):
        marker, length = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + length]
        if frame[at] != 0xFF or len(body) < length - 2 or length < 2:
            break
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            found |= {"sof": marker, "bits": body[0], "height": height, "width": width, "components": parts}
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                found["huffman"][body[0]], body = body[1:n], body[n:]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 1 + 64 * (1 + wide)
                found["quantizers"][body[0] & 15], body = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.int64), body[n:]
        elif marker == 0xDD:
            found["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if found["sof"] not in (0xC0, 0xC1, 0xC3) or found["bits"] != 8 or not found["height"] * found["width"]:
                raise ValueError("neither baseline nor lossless JPEG of eight bits")
            found |= {"scan": [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])], "predictor": body[1 + 2 * body[0]]}
            end = frame.rfind(b"\xff\xd9")
            return found, frame[at + 2 + length : end if end > at else len(frame)]
        at += 2 + length
    raise ValueError("a JPEG frame without a scan")


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Category and code length of every 16 bits that may come next; length 0 where no code fits."""
    categories, lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            span = slice(code << (16 - length), (code + 1) << (16 - length))
            categories[span], lengths[span] = table[k], length
            code, k = code + 1, k + 1
        code <<= 1
    return categories, lengths


def decode_lossless(parsed: list[tuple[dict, bytes]]) -> np.ndarray:
    """The samples of lossless frames that share shape and table."""
    if len(parsed) > TOGETHER:
        return np.concatenate([decode_lossless(parsed[at : at + TOGETHER]) for at in range(0, len(parsed), TOGETHER)])
    one, n = parsed[0][0], len(parsed)
    height, width = one["height"], one["width"]
    categories, lengths = lookup(one["huffman"][one["scan"][0][1] >> 4])
    coded = [p[1].replace(b"\xff\x00", b"\xff") for p in parsed]
    longest = max(map(len, coded)) + 4
    data = np.frombuffer(b"".join(c.ljust(longest, b"\xff") for c in coded), np.uint8).astype(np.int64)
    base, place = np.arange(n) * longest, np.zeros(n, np.int64)
    out = np.empty((height * width, n), np.int64)
    last = longest - 4
    for i in range(height * width):
        at = base + np.minimum(place >> 3, last)
        window = (data[at] << 24) | (data[at + 1] << 16) | (data[at + 2] << 8) | data[at + 3]
        bits = (window << (place & 7)) & 0xFFFFFFFF
        s, length = categories[bits >> 16], lengths[bits >> 16]
        value = ((bits << length) & 0xFFFFFFFF) >> (32 - s)
        out[i] = np.where(value < (1 << s) >> 1, value - (1 << s) + 1, value)
        place += length + s
    x = out.T.reshape(n, height, width)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return np.cumsum(x, axis=2).astype(np.uint8)


#: Row and column of each coefficient, in the order they are coded: along the diagonals, turning at each end.
ZIGZAG = np.array(sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1])))
_K = np.arange(8)
COSINES = np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16) * np.where(_K, 0.5, 8**-0.5)[:, None]


def decode_baseline(parsed: tuple[dict, bytes]) -> np.ndarray:
    """The first component of a baseline frame at the frame's size."""
    said, coded = parsed
    tables = {k: [v.tolist() for v in lookup(t)] for k, t in said["huffman"].items()}
    numbers = dict(said["scan"])
    if len(numbers) != len(said["components"]):
        raise ValueError("a frame of several scans")
    most_h, most_v = (max(c[k] for c in said["components"]) for k in (1, 2))
    across, down = -(-said["width"] // (8 * most_h)), -(-said["height"] // (8 * most_v))
    name, own_h, own_v, quantizer = said["components"][0]
    blocks = np.zeros((down * own_v, across * own_h, 64), np.int64)
    before, place, windows, restarts = dict.fromkeys(numbers, 0), 0, [], iter(re.split(rb"\xff[\xd0-\xd7]", coded))
    for unit in range(across * down):
        if not unit or (said["restart"] and unit % said["restart"] == 0):  # bits start anew
            data = np.frombuffer(next(restarts, b"").replace(b"\xff\x00", b"\xff") + b"\xff" * 4, np.uint8).astype(np.int64)
            wide = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            windows = ((wide[:, None] >> (8 - np.arange(8))) & 0xFFFF).ravel().tolist()  # the sixteen bits from each bit on
            before, place = dict.fromkeys(numbers, 0), 0
        for part, h, v, _ in said["components"]:
            (dc_s, dc_n), (ac_s, ac_n) = tables[numbers[part] >> 4], tables[16 + (numbers[part] & 15)]
            for k in range(h * v):
                values, i = [0] * 64, 0
                while i < 64:
                    if place >= len(windows):
                        raise ValueError("a frame ends early")
                    window = windows[place]
                    symbol, length = (ac_s[window], ac_n[window]) if i else (dc_s[window], dc_n[window])
                    if not length:
                        raise ValueError("a code that no table has")
                    place += length
                    run, s = (symbol >> 4, symbol & 15) if i else (0, symbol)
                    if i and not s:
                        if run != 15:
                            break
                        i += 16
                        continue
                    i += run
                    if i > 63 or place >= len(windows):
                        raise ValueError("a block of too many coefficients")
                    value = windows[place] >> (16 - s) if s else 0
                    place += s
                    values[i] = value if not s or value >> (s - 1) else value - (1 << s) + 1
                    i += 1
                before[part] += values[0]
                values[0] = before[part]
                if part == name:
                    blocks[unit // across * own_v + k // h, unit % across * own_h + k % h] = values
    x = np.zeros((*blocks.shape[:2], 8, 8))
    x[..., ZIGZAG[:, 0], ZIGZAG[:, 1]] = blocks * said["quantizers"][quantizer]
    plane = (COSINES.T @ x @ COSINES).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    plane = np.clip(np.round(plane + 128), 0, 255).astype(np.uint8)
    return plane.repeat(most_v // own_v, axis=0).repeat(most_h // own_h, axis=1)[: said["height"], : said["width"]]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The samples (height, width) of each frame; lossless ones of one shape and table are decoded together."""
    out: list = [None] * len(frames)
    alike: dict[tuple, list[tuple[int, tuple[dict, bytes]]]] = {}
    for i, frame in enumerate(frames):
        said, coded = parse_frame(frame)
        if said["sof"] == 0xC3:
            if said["predictor"] != 1 or len(said["components"]) != 1 or said["restart"]:
                raise ValueError("lossless frames are read with one component and prediction from the left")
            alike.setdefault((said["height"], said["width"], *said["huffman"].items(), said["scan"][0]), []).append((i, (said, coded)))
        else:
            out[i] = decode_baseline((said, coded))
    for own in alike.values():
        for (i, _), samples in zip(own, decode_lossless([p for _, p in own]), strict=True):
            out[i] = samples
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], rate: int = RATE) -> bytes:
    """An AVI file with one video stream of the frames, and its index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    header = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        movie.append(chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movie[-1])
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", header) + chunk(b"LIST", b"".join(movie)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, start: int, end: int):
    """(name, start, end) of the chunks between two offsets."""
    while start + 8 <= end:
        size = int.from_bytes(data[start + 4 : start + 8], "little")
        yield data[start : start + 4], start + 8, min(end, start + 8 + size)
        start += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames of the video stream, by the index or else by the movie's chunks, and the frame rate."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movie, index = float(RATE), None, None
    for name, start, end in chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if name == b"LIST" and data[start : start + 4] == b"hdrl":
            for inner, a, b in chunks(data, start + 4, end):
                if inner == b"LIST" and data[a : a + 4] == b"strl":
                    for part, c, _ in chunks(data, a + 4, b):
                        if part == b"strh" and data[c : c + 4] == b"vids":
                            scale, units = struct.unpack("<II", data[c + 20 : c + 28])
                            rate = units / scale
        elif name == b"LIST" and data[start : start + 4] == b"movi":
            movie = start, end
        elif name == b"idx1":
            index = data[start:end]
    if movie is None:
        return [], rate
    if index is None:
        return [data[a:b] for name, a, b in chunks(data, movie[0] + 4, movie[1]) if name[2:] in (b"dc", b"db")], rate
    entries = np.frombuffer(index, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    frames = []
    for name, at, size in zip(entries["name"].tolist(), entries["at"].tolist(), entries["size"].tolist(), strict=True):
        start = movie[0] + at
        if data[start : start + 4] != name or int.from_bytes(data[start + 4 : start + 8], "little") != size:
            raise ValueError("the index does not fit the movie")
        frames.append(data[start + 8 : start + 8 + size])
    return frames, rate


BINS = 32
#: Differences on either side that a cut's threshold adapts to, standard deviations above their mean, and the least step.
AROUND, DEVIATIONS, LEAST = 8, 2.0, 0.08


def histograms(frames: Sequence[np.ndarray]) -> np.ndarray:
    """The share of each of BINS brightnesses in each frame, TOGETHER frames at a time."""
    out = np.empty((len(frames), BINS))
    for at in range(0, len(frames), TOGETHER):
        some = frames[at : at + TOGETHER]
        sizes = np.array([f.size for f in some])
        flat = np.concatenate([f.ravel() for f in some]).astype(np.int64) * BINS // 256 + np.repeat(np.arange(len(some)), sizes) * BINS
        out[at : at + len(some)] = np.bincount(flat, minlength=len(some) * BINS).reshape(-1, BINS) / sizes[:, None]
    return out


def shots(frames: Sequence[np.ndarray]) -> list[tuple[int, int, float]]:
    """(first, end, mean difference within) of each shot: cuts are where the histograms' difference stands out from those around it."""
    n = len(frames)
    step = np.abs(np.diff(histograms(frames), axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate(([0.0], np.cumsum(v))) for v in (step, step * step))
    at = np.arange(len(step))
    low, high = np.maximum(0, at - AROUND), np.minimum(len(step), at + AROUND + 1)
    others = np.maximum(1, high - low - 1)
    mean = (sums[high] - sums[low] - step) / others
    deviation = np.sqrt(np.maximum(0, (squares[high] - squares[low] - step * step) / others - mean * mean))
    cuts = [0, *(np.flatnonzero(step > mean + DEVIATIONS * deviation + LEAST) + 1).tolist(), n]
    return [(a, b, float(step[a : b - 1].mean()) if b - a > 1 else 0.0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
