"""Operator 3, media columns: AVI files of motion-JPEG frames, read back to samples, shots and clips.

A payload is stored as grey samples, each the level of one 8 x 8 block: with a DC quantiser of 8 the
level comes back exactly, so the codec loses nothing. A frame is 64 samples wide (512 pixels) with a
restart marker after each row of blocks, which makes rows independent: all rows of a batch are
decoded in step, one sample of each at a time. The reader follows the RIFF structure and its idx1
index, never the writer's bookkeeping; frames of other writers are decoded as baseline pictures,
whatever their quantisers, codes and components, to the grey of their first component. Shots are cut
where the grey histogram of a frame differs from the last one's by more than an adaptive threshold,
as published for compressed-domain DC images.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, without

WIDTH, ROWS = 64, 32  # samples in a row, rows in a full frame
RATE = 25  # frames a second
BINS = 32

# Fixed values of the format: code lengths chosen for the categories 0 to 8 of DC differences (a
# prefix code with no all-ones word), and one AC code, end of block.
DC_LENGTHS = {0: 4, 1: 4, 2: 4, 3: 3, 4: 3, 5: 3, 6: 2, 7: 3, 8: 4}


def _canonical(lengths: dict[int, int]) -> tuple[dict[int, int], list[int], list[int]]:
    """Code words by the standard's rule: counting up, longer by a zero; counts for each length; symbols in order."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, at, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - at
        at = lengths[s]
        codes[s] = code
        code += 1
    return codes, [sum(v == n for v in lengths.values()) for n in range(1, 17)], order


DC_CODES, DC_COUNTS, DC_SYMBOLS = _canonical(DC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    quantisers = bytes([8]) + bytes([1]) * 63
    ac_counts = [1] + [0] * 15
    return b"".join(
        (
            b"\xff\xd8", _segment(0xDB, b"\x00" + quantisers), _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)), _segment(0xC4, b"\x10" + bytes(ac_counts) + b"\x00"),
            _segment(0xDD, struct.pack(">H", WIDTH)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


#: For each difference of two samples, -255 to 255: the bits of its code word, magnitude and end of block, and how many.
def _words() -> tuple[np.ndarray, np.ndarray]:
    words, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << size) - 1
        words[d + 255] = ((DC_CODES[size] << size) | extra) << 1  # the code of end of block is one bit, 0
        sizes[d + 255] = DC_LENGTHS[size] + size + 1
    return words, sizes


_WORDS, _SIZES = _words()


def encode_rows(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes, stuffed, of each row of ``samples`` (n x 64, bytes)."""
    n = len(samples)
    levels = samples.astype(np.int16)
    before = np.concatenate([np.full((n, 1), 128, np.int16), levels[:, :-1]], axis=1)
    at = (levels - before).astype(np.int64) + 255
    words, sizes = _WORDS[at].ravel(), _SIZES[at]
    bits_of_row = sizes.sum(axis=1)
    padded = (bits_of_row + 7) // 8 * 8
    row_start = np.concatenate([[0], np.cumsum(padded)])
    start = (row_start[:-1, None] + np.cumsum(sizes, axis=1) - sizes).ravel()
    bits = np.zeros(int(row_start[-1]), np.uint8)
    flat = sizes.ravel()
    for k in range(int(flat.max())):  # the k-th bit of every word that has one
        has = flat > k
        bits[start[has] + k] = (words[has] >> (flat[has] - 1 - k).astype(np.uint32)) & 1
    for k in range(7):  # rows end in ones
        at_end = row_start[:-1] + bits_of_row + k
        bits[at_end[bits_of_row + k < padded]] = 1
    coded = np.packbits(bits).tobytes()
    edges = (row_start // 8).tolist()
    return [coded[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(edges, edges[1:], strict=False)]


def jpeg(rows: list[bytes]) -> bytes:
    """A baseline JPEG picture of these coded rows."""
    out = [_header(len(rows)), rows[0]]
    for i, row in enumerate(rows[1:]):
        out += (bytes([0xFF, 0xD0 + i % 8]), row)
    return b"".join((*out, b"\xff\xd9"))


def avi(frames: list[bytes], rows: int) -> bytes:
    """A RIFF file of these frames: headers, the movi list and its idx1 index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, WIDTH * 8, rows * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0, 0, 0, 0, WIDTH * 8, rows * 8)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH * 8, rows * 8, 1, 24, b"MJPG", WIDTH * 8 * rows * 8 * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    body, index, at = [], [], 4
    for frame in frames:
        body.append(chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", b"".join(index)))


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zeros up to a positive multiple of 64, and their number without these."""
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\x00"), len(data)


def write_media(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload (a positive multiple of 64 bytes); all rows are encoded together."""
    coded = encode_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)) if payloads else []
    out, at = [], 0
    for payload in payloads:
        own = coded[at : at + len(payload) // WIDTH]
        at += len(own)
        out.append(avi([jpeg(own[i : i + ROWS]) for i in range(0, len(own), ROWS)], min(ROWS, len(own))))
    return out


def riff_frames(data: bytes) -> list[bytes]:
    """The frames that the idx1 index of an AVI file lists, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index = 12, 8 + struct.unpack_from("<I", data, 4)[0], None, None
    while at + 8 <= end:
        name, length = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + length]
        at += 8 + length + length % 2
    if movi is None or index is None:
        raise ValueError("an AVI file without movi list or index")
    found = []
    for i in range(0, len(index), 16):
        name, _, offset, length = struct.unpack_from("<4sIII", index, i)
        if name == b"00dc":
            found.append(data[movi + offset + 8 : movi + offset + 8 + length])
    return found


def _tables(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol for each 16 bits that a code word can begin."""
    sizes, values = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            sizes[low : low + (1 << (16 - length))], values[low : low + (1 << (16 - length))] = length, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return sizes, values


#: The code tables that a picture without any means (fixed values of the JPEG standard's annex K.3): class and place, code words of each length from 1 to 16, symbols.
STANDARD = {
    0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x10: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a"
        "636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
        "e1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")),
    0x11: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a"
        "636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
        "e2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa")),
}


class Picture:
    """What the markers of a baseline JPEG say, and its entropy-coded bytes.

    Quantisers stand in zigzag order by table; ``parts`` is (name, across, down, quantiser table) of
    each component, ``scan`` (name, DC table, AC table). Progressive and arithmetic-coded pictures
    are refused; frames that bring no code tables, as is common in AVI files, mean the standard's.
    """

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG picture")
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[int, tuple[bytes, bytes]] = dict(STANDARD)
        self.restart, self.parts, self.scan, at = 0, [], [], 2
        while not self.scan:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("a picture that is cut off")
            marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], f">u{wide}").astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif marker in (0xC0, 0xC1):
                self.rows, self.width = struct.unpack_from(">HH", body, 1)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError(f"a picture of kind {marker:#x}, which isn't baseline")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.codes[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        if not self.parts or [p[0] for p in self.parts] != [c[0] for c in self.scan] or any(t not in self.codes for _, d, a in self.scan for t in (d, 0x10 | a)) or any(p[3] not in self.quantisers for p in self.parts):
            raise ValueError("a picture whose tables or components are missing")
        end = data.rfind(b"\xff\xd9")
        self.coded = data[at : end if end > at else len(data)]

    def stretches(self) -> list[bytes]:
        """The coded bytes between restart markers, unstuffed."""
        return [r.replace(b"\xff\x00", b"\xff") for r in re.split(rb"\xff[\xd0-\xd7]", self.coded)]

    def levels_only(self) -> bool:
        """Whether it is of the kind that this module writes: one component, a restart a row, blocks of a level and no more."""
        return len(self.parts) == 1 and self.restart * 8 == self.width and self.rows % 8 == 0 and self.codes[0x10 | self.scan[0][2]][1] == b"\x00"


#: Places of a block's coefficients in the order they are coded: along diagonals, turning at each.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
#: The cosine transform's matrix, frequency by place.
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _stretch(data: bytes, scan: list[tuple], tables: list[tuple], units: int, blocks: list[list[list[int]]]) -> None:
    """Decodes up to ``units`` units of one stretch, each component's blocks of a unit in turn, into ``blocks``."""
    raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.uint32)
    window = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]).tolist()
    at, last, most = 0, [0] * len(scan), 8 * len(data)

    def bits(n: int) -> int:
        nonlocal at
        if at > most:
            raise ValueError("coded bytes end too early")
        out = (window[at >> 3] >> (32 - (at & 7) - n)) & ((1 << n) - 1)
        at += n
        return out

    def symbol(codes: tuple) -> int:
        nonlocal at
        if at > most:
            raise ValueError("coded bytes end too early")
        next16 = (window[at >> 3] >> (16 - (at & 7))) & 0xFFFF
        if not codes[0][next16]:
            raise ValueError("bits that are no code word")
        at += codes[0][next16]
        return codes[1][next16]

    def number(size: int) -> int:
        value = bits(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    for _ in range(units):
        for i, (n, dc, ac) in enumerate(tables):
            for _ in range(n):
                block = [0] * 64
                last[i] += number(symbol(dc))
                block[0], k = last[i], 1
                while k < 64:
                    run, size = divmod(symbol(ac), 16)
                    if not size and run != 15:
                        break
                    k += run
                    if size and k < 64:
                        block[k] = number(size)
                    k += 1
                blocks[i].append(block)


def decode_picture(picture: Picture) -> np.ndarray:
    """The grey samples (rows x width) of any baseline picture: those of its first component, enlarged if it is a sparser one."""
    across, down = max(p[1] for p in picture.parts), max(p[2] for p in picture.parts)
    alone = len(picture.parts) == 1
    if alone:  # a component alone is coded block by block
        across = down = 1
    wide, high = -(-picture.width // (8 * across)), -(-picture.rows // (8 * down))
    tables = []
    for (_, h, v, _), (_, d, a) in zip(picture.parts, picture.scan, strict=True):
        tables.append((1 if alone else h * v, *[tuple(t.tolist() for t in _tables(*picture.codes[c])) for c in (d, 0x10 | a)]))
    blocks: list[list[list[int]]] = [[] for _ in picture.parts]
    left = wide * high
    for data in picture.stretches():
        units = min(left, picture.restart or left)
        _stretch(data, picture.scan, tables, units, blocks)
        left -= units
    if left:
        raise ValueError("a picture with too few coded blocks")
    _, h, v, table = picture.parts[0]
    h, v = (1, 1) if alone else (h, v)
    levels = np.zeros((len(blocks[0]), 64))
    levels[:, ZIGZAG] = np.array(blocks[0]) * picture.quantisers[table]
    samples = COSINES.T @ levels.reshape(-1, 8, 8) @ COSINES + 128
    grid = samples.reshape(high, wide, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * v * 8, wide * h * 8)
    grid = grid.repeat(down // v, axis=0).repeat(across // h, axis=1)[: picture.rows, : picture.width]
    return np.clip(np.rint(grid), 0, 255).astype(np.uint8)


def jpeg_rows(data: bytes | Picture) -> tuple[tuple, list[bytes]]:
    """What decoding a frame of this module's kind takes (width, quantiser, code tables) and its coded rows, unstuffed."""
    picture = data if isinstance(data, Picture) else Picture(data)
    (_, _, _, table), (_, d, a) = picture.parts[0], picture.scan[0]
    return (picture.width // 8, int(picture.quantisers[table][0]), picture.codes[d], picture.codes[0x10 | a]), picture.stretches()


def decode_rows(how: tuple, rows: list[bytes]) -> np.ndarray:
    """The samples of all rows (n x width), decoded in step: the i-th sample of every row at once."""
    width, quantiser, dc, ac = how
    dc_sizes, dc_values = _tables(*dc)
    ac_sizes, ac_values = _tables(*ac)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])[:-1] * 8
    data = np.frombuffer(b"".join(rows) + b"\x00" * 8, np.uint8).astype(np.uint32)
    at24 = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at, level, out = starts.astype(np.int64), np.zeros(len(rows), np.int64), np.empty((len(rows), width), np.int16)
    peek = lambda p: (at24[p >> 3] >> (16 - (p & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF
    for i in range(width):
        window = peek(at)
        size, category = dc_sizes[window], dc_values[window]
        at = at + size
        extra = peek(at) >> (16 - category)
        level = level + np.where((category > 0) & (extra < (1 << np.maximum(category - 1, 0))), extra - (1 << category) + 1, extra)
        at = at + category
        window = peek(at)
        at = at + ac_sizes[window]
        out[:, i] = level
    return (out * quantiser // 8 + 128).astype(np.uint8)


def read_media(files: list[bytes]) -> list[list[np.ndarray] | ValueError]:
    """The frames of each AVI file as arrays of samples, or why it can't be read; rows with the same tables are decoded together."""
    groups: dict[tuple, list[bytes]] = {}
    spots: list[list[tuple[tuple, int, int] | np.ndarray] | ValueError] = []
    for data in files:
        try:
            own: list[tuple[tuple, int, int] | np.ndarray] = []
            pictures = [Picture(frame) for frame in riff_frames(data)]
            for picture in pictures:
                if not picture.levels_only():
                    own.append(decode_picture(picture))
                    continue
                how, rows = jpeg_rows(picture)
                mine = groups.setdefault(how, [])
                own.append((how, len(mine), len(mine) + len(rows)))
                mine += rows
            spots.append(own if own else ValueError("a file without frames"))
        except (ValueError, IndexError, struct.error) as wrong:
            spots.append(ValueError(str(wrong)))
    decoded = {how: decode_rows(how, rows) for how, rows in groups.items()}
    return [own if isinstance(own, ValueError) else [x if isinstance(x, np.ndarray) else decoded[x[0]][x[1] : x[2]] for x in own] for own in spots]


def shots(frames: list[np.ndarray], span: int = 8, factor: float = 3.0, least: float = 0.15) -> list[tuple[int, int]]:
    """Clips as (first frame, end): cut where the histogram differs by more than mean + factor x deviation of the last ``span`` differences."""
    grams = [np.bincount(f.ravel() // (256 // BINS), minlength=BINS) / f.size for f in frames]
    changes = [float(np.abs(a - b).sum()) / 2 for a, b in zip(grams, grams[1:], strict=False)]
    cuts = [0]
    for i, change in enumerate(changes):
        recent = np.array(changes[max(cuts[-1], i - span) : i])
        limit = max(least, recent.mean() + factor * recent.std()) if len(recent) else least
        if change > limit:
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(frames)], strict=True))


def store(docs: DataFrame, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with ``media`` (an AVI file) and ``n_bytes`` (of the text, unpadded) in place of the text.

    Each row is stored by itself, repeated ones too, and an empty table gives no rows; columns of
    ``docs`` named as these two give way. Null and empty texts are stored as 64 zeros. Frames are as many as a text needs, so very long
    ones are one file of many frames. Batches are encoded in slices of ``batch_bytes``.
    """
    import pyarrow as pa

    docs = without(docs, "media", "n_bytes")
    kept = [f for f in docs.schema.fields if f.name != text_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, batch_bytes):
                payloads = [padded(t) for t in batch.column(text_col).to_pylist()]
                more = [pa.array(write_media([p for p, _ in payloads]), pa.binary()), pa.array([n for _, n in payloads], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *more], names=[*(f.name for f in kept), "media", "n_bytes"])

    return docs.mapInArrow(each, T.StructType([*kept, T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())]))


CLIP = T.ArrayType(T.StructType([T.StructField("first_frame", T.IntegerType()), T.StructField("n_frames", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))


def analyse(stored: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """``stored`` with what reading ``media`` back gives: payload digests, clips and a feature, in place of the file.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, ``clips`` (timed shots), ``feature`` (frames, shots, mean level and its spread)
    and ``error``. A file that can't be read has its bytes and digest, an error that says why, and
    nulls else; a null file has nulls. Each row is read by itself, repeated ones too, an empty table
    gives no rows, and columns of ``stored`` named as those added give way.
    """
    import pyarrow as pa

    added = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("clips", CLIP), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())])
    stored = without(stored, *added.names)
    kept = [f for f in stored.schema.fields if f.name != "media"]
    clip = pa.list_(pa.struct([("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip, pa.string(), pa.string()]

    def described(data: bytes, frames: list[np.ndarray] | ValueError) -> tuple:
        if isinstance(frames, ValueError):
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None, str(frames)
        payload = b"".join(f.tobytes() for f in frames)
        found = shots(frames)
        means = [float(f.mean()) for f in frames]
        clips = [{"first_frame": a, "n_frames": b - a, "start_s": a / RATE, "end_s": b / RATE} for a, b in found]
        feature = f"frames={len(frames)};shots={len(found)};level={sum(means) / len(means):.3f};spread={max(means) - min(means):.3f}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), clips, feature, None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", batch_bytes):
                files = batch.column("media").to_pylist()
                read = iter(read_media([f for f in files if f is not None]))
                rows = [described(f, next(read)) if f is not None else (None,) * len(types) for f in files]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *added.names])

    return stored.mapInArrow(each, T.StructType([*kept, *added.fields]))


def clip_rows(analysed: DataFrame, *keep: str) -> DataFrame:
    """A row for each timed clip of :func:`analyse`'s rows: ``keep``, first_frame, n_frames, start_s, end_s; files without clips give none."""
    return analysed.select(*[F.col(f"`{c}`") for c in keep], F.explode("clips").alias("_clip")).select(*[F.col(f"`{c}`") for c in keep], "_clip.*")
