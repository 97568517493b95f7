"""Pictures of other writers, damaged files and clip rows; damaged archives."""

import gzip
import io
import random
import struct

import numpy as np
import pytest

from locusflow.llm import media, warc

DC, AC = {s: 4 for s in range(12)}, {s: 8 if s < 128 else 9 for s in range(256)}


def code_words(counts, symbols):
    """Bits of each symbol, codes of a length following each other."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = f"{code:0{length}b}"
            code, k = code + 1, k + 1
        code <<= 1
    return out


def encode(planes, quantiser, sampling, restart, standard=False):
    """A JPEG picture of coefficient blocks, a bit at a time: planes[i] is rows x columns of 64 zigzag numbers; with the ``standard`` tables, none is written."""
    out, bits = [b"\xff\xd8", media._segment(0xDB, b"\x00" + bytes(quantiser))], ""
    tables = dict(media.STANDARD) if standard else {}
    for name, lengths in () if standard else ((0x00, DC), (0x10, AC)):
        _, counts, symbols = media._canonical(lengths)
        out.append(media._segment(0xC4, bytes([name, *counts, *symbols])))
        tables[name] = tables[name + 1] = (bytes(counts), bytes(symbols))
    words = {name: code_words(*table) for name, table in tables.items()}
    place = lambda i: int(standard and i > 0)  # noqa: E731  colours have tables of their own
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    high, wide = len(planes[0]) // sampling[0][1], len(planes[0][0]) // sampling[0][0]
    frame = struct.pack(">BHHB", 8, high * down * 8 - 3, wide * across * 8 - 5, len(planes))
    out.append(media._segment(0xC0, frame + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))))
    if restart:
        out.append(media._segment(0xDD, struct.pack(">H", restart)))
    out.append(media._segment(0xDA, bytes([len(planes), *[x for i in range(len(planes)) for x in (i + 1, 0x11 * place(i))], 0, 63, 0])))

    def number(n):
        size = abs(n).bit_length()
        return f"{n if n >= 0 else n + (1 << size) - 1:0{size}b}" if size else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    last = [0] * len(planes)
    for unit in range(high * wide):
        if restart and unit and unit % restart == 0:
            out += [flush(bits), bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])]
            bits, last = "", [0] * len(planes)
        y, x = divmod(unit, wide)
        for i, (h, v) in enumerate(sampling):
            for b in range(h * v):
                block = planes[i][y * v + b // h][x * h + b % h]
                d = block[0] - last[i]
                last[i] = block[0]
                bits += words[place(i)][abs(d).bit_length()] + number(d)
                run = 0
                for k in range(1, 64):
                    if not block[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits += words[0x10 + place(i)][0xF0]
                        run -= 16
                    bits += words[0x10 + place(i)][run << 4 | abs(block[k]).bit_length()] + number(block[k])
                    run = 0
                if run:
                    bits += words[0x10 + place(i)][0]
    return b"".join([*out, flush(bits), b"\xff\xd9"])


def slow_grey(plane, quantiser):
    """Samples by the transform's own double sum."""
    rows = []
    for line in plane:
        done = []
        for block in line:
            f = np.zeros((8, 8))
            for k, place in enumerate(media.ZIGZAG):
                f[place // 8, place % 8] = block[k] * quantiser[k]
            c = lambda u: 2**-0.5 if u == 0 else 1.0
            done.append([[sum(c(u) * c(v) / 4 * f[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8) if f[u, v]) + 128 for x in range(8)] for y in range(8)])
        rows.append(np.concatenate(done, axis=1))
    return np.clip(np.concatenate(rows), 0, 255)


def test_the_standard_tables_are_whole():
    """Each kind has every symbol once, and its code words leave only the one of all ones."""
    pairs = sorted([0x00, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]])
    for name, (counts, symbols) in media.STANDARD.items():
        assert sum(counts) == len(symbols) and sorted(symbols) == (pairs if name >= 0x10 else list(range(12)))
        assert sum(n << (16 - length) for length, n in enumerate(counts, 1)) < 1 << 16


@pytest.mark.parametrize("standard", [False, True])
@pytest.mark.parametrize(("sampling", "restart"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_pictures_of_other_writers(sampling, restart, standard):
    draw = random.Random(4)
    quantiser = [1 + k // 3 for k in range(64)]
    block = lambda: [draw.randrange(-60, 60), *[draw.choice([0] * draw.choice((3, 40)) + [draw.randrange(-9, 10)]) for _ in range(63)]]
    planes = [[[block() for _ in range(3 * h)] for _ in range(2 * v)] for h, v in sampling]
    data = encode(planes, quantiser, sampling, restart, standard)
    assert (b"\xff\xc4" in data[:200]) is not standard
    want = slow_grey(planes[0], quantiser)
    (frames,) = media.read_media([media.avi([data, data], 2)])
    assert len(frames) == 2 and frames[0].shape == (want.shape[0] - 3, want.shape[1] - 5)
    assert np.abs(frames[0].astype(float) - want[:-3, :-5]).max() <= 0.51


def test_damaged_files_and_clips(spark):
    draw = random.Random(5)
    dark, light = (np.full(64 * 32, level, np.uint8).tobytes() for level in (20, 220))
    good = media.write_media([dark * 3 + light * 4])[0]
    cut = good[: len(good) // 2]
    noise = bytes(draw.randrange(256) for _ in range(300))
    bent = good.replace(b"\xff\xc0", b"\xff\xc2")  # says that frames are progressive
    rows = [(0, good), (1, cut), (2, noise), (3, b""), (4, None), (5, bent), (6, good)]
    stored = spark.createDataFrame(rows, "doc_id long, media binary").selectExpr("*", "'x' AS error", "'y' AS clips")
    out = {r.doc_id: r for r in media.analyse(stored).collect()}
    assert out[0].error is None and out[0].payload_bytes == 64 * 32 * 7 and out[0].feature == out[6].feature and out[4].error is None
    assert all(out[i].error and out[i].payload_bytes is None and out[i].media_bytes == len(rows[i][1]) for i in (1, 2, 3, 5))
    clips = [tuple(r) for r in media.clip_rows(media.analyse(stored), "doc_id").orderBy("doc_id", "first_frame").collect()]
    assert clips == [(i, *c) for i in (0, 6) for c in ((0, 3, 0.0, 0.12), (3, 4, 0.12, 0.28))]


def test_archives_of_other_writers_and_damaged_ones(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}" * 50) for i in range(5)], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), f"file://{tmp_path}/w")
    (file,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    whole = gzip.decompress(file.read_bytes())
    records = list(warc.parse(io.BytesIO(whole)))
    assert len(records) == 15
    starts = [i for i in range(len(whole)) if whole.startswith(b"WARC/1.1\r\n", i)] + [len(whole)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/members.warc.gz").write_bytes(b"".join(gzip.compress(whole[a:b]) for a, b in zip(starts, starts[1:], strict=False)))
    assert sorted(r.page_id for r in warc.captures(warc.assemble(warc.read(spark, f"file://{tmp_path}/x"))).collect()) == [0, 1, 2, 3, 4]
    (tmp_path / "x/cut.warc").write_bytes(whole[: starts[4] + 150])
    (tmp_path / "x/packed.warc.gz").write_bytes(file.read_bytes()[:200])
    (tmp_path / "x/noise.warc").write_bytes(b"\x00\x01noise\n")
    found = warc.read(spark, f"file://{tmp_path}/x").collect()
    assert sum(r.error is not None for r in found) == 3 and sum(r.error is None for r in found) >= 15 + 4
    assert len(warc.captures(warc.assemble(warc.read(spark, f"file://{tmp_path}/x"))).collect()) >= 5


def test_equal_ids_and_payloads_keep_their_urls(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "http://a/", big), (1, "http://b/", big), (2, "http://c/", big)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    found = warc.assemble(warc.read(spark, f"file://{tmp_path}/w"))
    assert sorted((r.response.target_uri, r.request.target_uri, r.response.type) for r in found.collect()) == [("http://a/", "http://a/", "response"), ("http://b/", "http://b/", "response"), ("http://c/", "http://c/", "revisit")]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.captures(found).collect()) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_ids_that_are_text(spark, tmp_path):
    big = "<p>" + "x" * 200
    ids = ["p1", "p 2\r\npage-id: 9", "é", "", "-7", None]
    pages = spark.createDataFrame([(i, "http://h", big) for i in ids], "page_id string, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.captures(warc.assemble(warc.read(spark, f"file://{tmp_path}/w")), "string").collect()}
    assert out == {i: ("response", None) if i == "" else ("revisit", "") for i in ids}
