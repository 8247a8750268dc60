"""Media columns: motion JPEG in AVI containers.

Reads RIFF indexes, decodes intra frames (baseline JPEG and lossless JPEG with Huffman codes) and detects shots where
the difference of neighbouring frames' histograms leaves what is usual around it. Also writes such files: a payload
becomes the 8-bit samples of lossless JPEG frames of 64 samples a line, so any bytes come back exactly. The Huffman
table written gives a difference of s bits a code of 9 - s bits, so that all codes with their bits have nine bits in
all and whole films are coded with array operations; a reader meets it as any other table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts, text_rows

WIDTH, LINES, FPS = 64, 16, 25
CODE = 9
BINS = 16
#: A cut differs from its neighbours' mean by this many of their standard deviations, and by this much at least.
SPREAD, LEAST, AROUND = 3.0, 0.25, 4


# -- writing -------------------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(height: int, width: int) -> bytes:
    """Start of image up to the start of scan: one 8-bit component, lossless, predicted from the left neighbour."""
    sizes = bytes([1 if 1 <= n <= CODE else 0 for n in range(1, 17)])
    frame = _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
    table = _segment(0xC4, b"\0" + sizes + bytes(range(CODE - 1, -1, -1)))
    return b"\xff\xd8" + frame + table + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def _differences(samples: np.ndarray) -> np.ndarray:
    """Each sample less its left neighbour; the first of a line less the one above, the very first less 128."""
    before = np.empty_like(samples)
    before[..., 1:] = samples[..., :-1]
    before[..., 1:, 0] = samples[..., :-1, 0]
    before[..., 0, 0] = 128
    return samples - before


def _scans(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded bits of frames (n, lines, width)."""
    d = _differences(samples.astype(np.int16)).reshape(len(samples), -1)
    size = np.zeros(d.shape, np.int16)
    magnitude = np.abs(d)
    for s in range(CODE - 1):
        size += magnitude >> s > 0
    prefix = ((1 << (CODE - size)) - 2) << size  # the code of size s: 8 - s ones, then a zero, ...
    word = np.where(d == 0, (1 << CODE) - 2, prefix | np.where(d < 0, d + (1 << size) - 1, d)).astype(">u2")
    bits = np.unpackbits(word.view(np.uint8).reshape(len(samples), -1, 2), axis=2)[..., 16 - CODE :].reshape(len(samples), -1)
    spare = -bits.shape[1] % 8
    packed = np.packbits(np.pad(bits, ((0, 0), (0, spare)), constant_values=1), axis=1)
    return [row.tobytes().replace(b"\xff", b"\xff\0") for row in packed]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes, width: int = WIDTH, lines: int = LINES, fps: int = FPS) -> bytes:
    """An AVI file whose lossless JPEG frames hold the payload, whose length must be a positive multiple of `width`."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    full = len(samples) // lines
    frames = []
    head, tail = _jpeg_head(lines, width), b"\xff\xd9"
    if full:
        frames += [head + scan + tail for scan in _scans(samples[: full * lines].reshape(full, lines, width))]
    if rest := len(samples) - full * lines:
        frames += [_jpeg_head(rest, width) + scan + tail for scan in _scans(samples[full * lines :][None])]
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, lines, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 10_000, 0, 0, 0, width, lines)
    form = struct.pack("<IiiHH4sIiiII", 40, width, lines, 1, 8, b"MJPG", width * lines, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    movie, index, at = [], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movie.append(chunk)
        at += len(chunk)
    body = b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", b"movi" + b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


# -- reading -------------------------------------------------------------------------------------------------------------------


@dataclass
class Film:
    seconds_a_frame: float
    frames: list[bytes]


def parse_avi(data: bytes) -> Film:
    """The frames of the first video stream by the file's index, or by walking the movie list where there is none.

    Raises ValueError for data that isn't an AVI file; frames that reach beyond the end are left out.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    wait, movie, index = 1 / FPS, None, []
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    walked: list[tuple[int, int]] = []
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movie = body
                stack.append((body + 4, min(end, body + size)))
            elif name == b"avih" and size >= 4:
                wait = (struct.unpack_from("<I", data, body)[0] or 40_000) / 1e6
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, body + i) for i in range(0, min(size, len(data) - body) - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                walked.append((body, size))
            at = body + size + size % 2
    places = []
    if index and movie is not None:
        shown = [(at, size) for name, _, at, size in index if name[2:] in (b"dc", b"db")]
        # offsets count from the movie list, in some files from the start of the file
        base = 0 if shown and data[shown[0][0] : shown[0][0] + 4] in (b"00dc", b"00db") else movie
        places = [(base + at + 8, size) for at, size in shown]
    places = places or sorted(walked)
    return Film(wait, [data[at : at + size] for at, size in places if at + size <= len(data)])


@lru_cache(256)
def _huffman(body: bytes) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """Tables of a DHT segment by (class, number): (length, code) to symbol."""
    tables, at = {}, 0
    while at + 17 <= len(body):
        key, sizes = (body[at] >> 4, body[at] & 15), body[at + 1 : at + 17]
        at += 17
        code, table = 0, {}
        for length, n in enumerate(sizes, 1):
            for _ in range(n):
                table[length, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        tables[key] = table
    return tables


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("scan ends early")
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(1 / 4)) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Samples (lines, width) of a frame's first component: baseline (SOF0) or lossless with left prediction (SOF3)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, tables, quant, frame, restart = 2, {}, {}, None, 0
    while at + 4 <= len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            tables |= _huffman(body)
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)
                i += 65 + 64 * wide
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC3):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = (marker, height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame header")
    end = data.rfind(b"\xff\xd9")
    scan = data[at : end if end >= at else len(data)]
    chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
    if frame[0] == 0xC3:
        return _lossless(scan, frame, tables[0, chosen[frame[3][0][0]][0]], restart)
    return _baseline(scan, frame, tables, quant, chosen, restart)


def _lossless(scan: bytes, frame, table, restart: int) -> np.ndarray:
    _, height, width, components = frame
    if restart or len(components) != 1:
        raise ValueError("one component without restarts is read")
    raw = scan.replace(b"\xff\0", b"\xff")
    count = height * width
    lengths = {length + symbol for (length, _), symbol in table.items() if symbol}
    if lengths == {CODE} and all(length in (CODE, CODE - s) for (length, _), s in table.items()):
        # every code with its bits has the same length: all samples at once
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: count * CODE].reshape(count, CODE)
        word = bits @ (1 << np.arange(CODE - 1, -1, -1))
        d = _values(tuple(table.items()))[word].reshape(height, width)
    else:
        bits = _Bits(raw)
        d = np.array([bits.signed(bits.symbol(table)) for _ in range(count)]).reshape(height, width)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return (np.cumsum(d, axis=1) & 0xFFFF).astype(np.uint8)


@lru_cache(64)
def _values(table: tuple[tuple[tuple[int, int], int], ...]) -> np.ndarray:
    """The signed difference that each word of a code and its bits stands for."""
    value = np.zeros(1 << CODE, np.int64)
    for (length, code), s in table:
        span = np.arange(1 << s)
        value[(code << s) + span] = np.where(span >> (s - 1) & 1, span, span - (1 << s) + 1) if s else 0
    return value


def _baseline(scan: bytes, frame, tables, quant, chosen, restart: int) -> np.ndarray:
    _, height, width, components = frame
    most_h, most_v = max(c[1] for c in components), max(c[2] for c in components)
    if len(components) == 1:
        components, most_h, most_v = [(components[0][0], 1, 1, components[0][3])], 1, 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    first = components[0]
    plane = np.zeros((down * 8 * first[2], across * 8 * first[1]))
    parts, start = [], 0
    for i in range(len(scan) - 1):  # restart markers part the scan
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            parts.append(scan[start:i])
            start = i + 2
    parts = [p.replace(b"\xff\0", b"\xff") for p in (*parts, scan[start:])]
    bits, part, dc = _Bits(parts[0]), 0, dict.fromkeys((c[0] for c in components), 0)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            part += 1
            bits, dc = _Bits(parts[part]), dict.fromkeys(dc, 0)
        for name, h, v, q in components:
            for sub in range(h * v):
                block = np.zeros(64, np.int64)
                dc[name] += bits.signed(bits.symbol(tables[0, chosen[name][0]]))
                block[0] = dc[name]
                k = 1
                while k < 64:
                    run, size = divmod(bits.symbol(tables[1, chosen[name][1]]), 16)
                    if not size:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    block[k] = bits.signed(size)
                    k += 1
                if name == first[0]:
                    whole = np.zeros(64)
                    whole[ZIGZAG] = block * quant[q]
                    y, x = (unit // across * v + sub // h) * 8, (unit % across * h + sub % h) * 8
                    plane[y : y + 8, x : x + 8] = DCT.T @ whole.reshape(8, 8) @ DCT
    return np.clip(np.rint(plane[:height, :width]) + 128, 0, 255).astype(np.uint8)


# -- shots ---------------------------------------------------------------------------------------------------------------------


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Shares of `BINS` equal ranges of samples in each frame."""
    if not frames:
        return np.zeros((0, BINS))
    owner = np.repeat(np.arange(len(frames)), [f.size for f in frames])
    values = np.concatenate([f.reshape(-1) for f in frames]) // (256 // BINS)
    counts = np.bincount(owner * BINS + values, minlength=BINS * len(frames)).reshape(len(frames), BINS)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, end) frame numbers of each shot; a cut's difference stands out of the `AROUND` differences on either side."""
    h = histograms(frames)
    if not len(h):
        return []
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    n = np.arange(len(d))
    low, high = np.maximum(n - AROUND, 0), np.minimum(n + AROUND + 1, len(d))
    sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    others = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - d) / others
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - d * d) / others - mean**2, 0))
    cuts = [0, *(int(i) + 1 for i in np.flatnonzero((d > mean + SPREAD * spread) & (d >= LEAST))), len(h)]
    return list(zip(cuts, cuts[1:]))


def clips_of(data: bytes) -> list[tuple[int, int, float, float]]:
    """(first frame, end frame, start second, end second) of each shot of an AVI file."""
    film = parse_avi(data)
    return [(a, b, a * film.seconds_a_frame, b * film.seconds_a_frame) for a, b in shots([decode_jpeg(f) for f in film.frames])]


def clips(media: DataFrame) -> DataFrame:
    """media(doc_id, media binary) to timed clip rows (doc_id, clip, first_frame, end_frame, start_s, end_s).

    Null, empty and unreadable media have no clips; repeated rows give repeated clips.
    """
    import pyarrow as pa

    from marquee.llm.common import map_arrow

    names = ("doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())

    def run(batches):
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                try:
                    found = clips_of(data) if data else []
                except (ValueError, KeyError, IndexError, struct.error):
                    found = []
                rows += [(doc, i, *clip) for i, clip in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=list(names))

    return map_arrow(media.select("doc_id", "media"), run, "doc_id bigint, clip int, first_frame int, end_frame int, start_s double, end_s double")


# -- texts as media --------------------------------------------------------------------------------------------------------------


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes of the text with bytes 0 up to a positive multiple of 64, and their number before."""
    raw = text.encode("utf-8", "replace")
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): every text's padded bytes as an AVI file; null text counts as empty."""
    return map_texts(text_rows(docs), lambda: lambda texts: [[encode_avi(padded(t)[0]) for t in texts]], "media binary")


def _described(text: str) -> tuple:
    payload, n = padded(text)
    media = encode_avi(payload)
    film = parse_avi(media)
    frames = [decode_jpeg(f) for f in film.frames]
    back = b"".join(f.tobytes() for f in frames)
    cut = shots(frames)
    h = histograms(frames)
    mean = (h * np.array([f.size for f in frames])[:, None]).sum(0) / len(back)
    feature = f"frames={len(frames)};shots={len(cut)};cuts={','.join(str(round(a * film.seconds_a_frame, 3)) for a, _ in cut[1:])};histogram={','.join(f'{x:.4f}' for x in mean)}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(cut)


def describe_texts(docs: DataFrame) -> DataFrame:
    """Every text stored as an AVI file, read back and described.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_clips): hashes
    and the checksum of the last 64 bytes are of what was read back; equal texts give equal values. Null and empty
    texts are 64 bytes 0. One row for each row of docs.
    """
    fields = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_clips int"
    return map_texts(text_rows(docs), lambda: lambda texts: list(map(list, zip(*map(_described, texts)))) or [[]] * 8, fields)
