"""Drawings of the views as SVG, PNG, GIF and MP4, without a plotting library.

A drawing holds what fits on a page: of each line only the outline reaches the driver, at most four points for each place
across the page, which draw as all points would.
Animations are coded by executors and written frame by frame, however many there are.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources.files import written_parts

WIDTH, HEIGHT, MARGIN = 900, 360, 50
#: Black for cluster 0, then ten colours that repeat.
COLOURS = ["#000000", "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"]
#: A font of 3 x 5 dots for pixel drawings, row by row.
FONT = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ.-:|", (
    "111101101101111 010110010010111 111001111100111 111001111001111 101101111001001 111100111001111 111100111101111 111001001001001 111101111101111 111101111001111 "
    "010101111101101 110101110101110 011100100100011 110101101101110 111100110100111 111100110100100 011100101101011 101101111101101 111010010010111 001001001101010 "
    "101101110101101 100100100100111 101111111101101 110101101101101 010101101101010 110101110100100 010101101110011 110101110101101 011100010001110 111010010010010 "
    "101101101101111 101101101101010 101101111111101 101101010101101 101101010010010 111001010100111 000000000000010 000000111000000 000010000010000 010010010010010").split(), strict=True))


def index_of(cluster: int | None) -> int:
    """The place of a cluster's colour among COLOURS."""
    return 1 if cluster is None else 0 if cluster == 0 else 1 + (cluster - 1) % 10


def colour(cluster: int | None) -> str:
    return COLOURS[index_of(cluster)]


def rgb(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text[1:]), dtype=np.uint8)


class Vector:
    """A page as SVG."""

    def __init__(self, width: int, height: int):
        self.width, self.height, self.body = width, height, []

    def text(self, x: float, y: float, text: str) -> None:
        self.body.append(f'<text x="{x:.0f}" y="{y:.0f}">{text}</text>')

    def box(self, x: float, y: float, width: float, height: float) -> None:
        self.body.append(f'<rect x="{x}" y="{y}" width="{width}" height="{height}" fill="none" stroke="#999"/>')

    def square(self, x: float, y: float, side: float, tint: str) -> None:
        self.body.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{side}" height="{side}" fill="{tint}"/>')

    def line(self, points: list[tuple[float, float]], tint: str, strength: float = 1.0) -> None:
        self.body.append(f'<polyline fill="none" stroke="{tint}" stroke-width="1.5" opacity="{strength}" points="' + " ".join(f"{x:.1f},{y:.1f}" for x, y in points) + '"/>')

    def data(self) -> bytes:
        head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.width}" height="{self.height}" font-family="sans-serif" font-size="12"><rect width="100%" height="100%" fill="white"/>'
        return (head + "".join(self.body) + "</svg>\n").encode()


class Pixels:
    """A page as PNG."""

    def __init__(self, width: int, height: int):
        self.image = np.full((height, width, 3), 255, dtype=np.uint8)

    def text(self, x: float, y: float, text: str) -> None:
        for k, c in enumerate(text.upper()):
            dots = np.array(list(FONT.get(c, "0" * 15))) == "1"
            for row, col in zip(*np.nonzero(dots.reshape(5, 3)), strict=True):
                self.square(x + 8 * k + 2 * col, y - 10 + 2 * row, 2, "#000000")

    def box(self, x: float, y: float, width: float, height: float) -> None:
        self.line([(x, y), (x + width, y), (x + width, y + height), (x, y + height), (x, y)], "#999999")

    def square(self, x: float, y: float, side: float, tint: str) -> None:
        a, b = max(0, round(x)), max(0, round(y))
        self.image[b : max(0, round(y + side)), a : max(0, round(x + side))] = rgb(tint)

    def line(self, points: list[tuple[float, float]], tint: str, strength: float = 1.0) -> None:
        shade = (255 - strength * (255 - rgb(tint).astype(float))).astype(np.uint8)
        for (x, y), (v, w) in zip(points, points[1:] or points, strict=False):
            n = int(max(abs(v - x), abs(w - y))) + 1
            rows, cols = np.linspace(y, w, n + 1).round().astype(int), np.linspace(x, v, n + 1).round().astype(int)
            inside = (rows >= 0) & (rows < self.image.shape[0]) & (cols >= 0) & (cols < self.image.shape[1])
            self.image[rows[inside], cols[inside]] = shade

    def data(self) -> bytes:
        return png(self.image)


def png(image: np.ndarray, palette: bytes = b"") -> bytes:
    """An image of rows of RGB, or of places in a palette of RGB."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)  # each row begins with its filter, none
    head = struct.pack(">IIBBBBB", width, height, 8, 3 if palette else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


PAGES = {"svg": Vector, "png": Pixels}


def page(path: str, width: int, height: int) -> Vector | Pixels:
    """An empty page of the kind that the file's name says."""
    kind = os.path.splitext(path)[1].lstrip(".").lower()
    if kind not in PAGES:
        raise ValueError(f"unknown format {kind}")
    return PAGES[kind](width, height)


def _write(path: str, on: Vector | Pixels) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        f.write(on.data())
    return path


def thinned(series: DataFrame, points: int = WIDTH) -> DataFrame:
    """At most ``points`` rows a line: the mean of each of as many equal ranges of frames."""
    low, high = series.agg(F.min("frame"), F.max("frame")).first()
    step = max(1, (high - low) // points + 1) if low is not None else 1
    x = series.groupBy("panel", "cluster", "kind", F.floor((F.col("frame") - F.lit(low or 0)) / step).alias("k"))
    return x.agg(F.min("frame").alias("frame"), F.avg("value").alias("value"))


def outlined(series: DataFrame, points: int = WIDTH) -> DataFrame:
    """At most 4 * ``points`` rows a line: the first, last, lowest and highest row of each of ``points`` equal ranges of frames.

    A line through them covers the same values at each place across the page as one through all rows, peaks included.
    """
    low, high = series.agg(F.min("frame"), F.max("frame")).first()
    step = max(1, (high - low) // points + 1) if low is not None else 1
    x = series.groupBy("panel", "cluster", "kind", F.floor((F.col("frame") - F.lit(low or 0)) / step).alias("k"))
    ends, peaks = F.struct("frame", "value"), F.struct("value", "frame")
    x = x.agg(F.min(ends).alias("a"), F.max(ends).alias("b"), F.min(peaks).alias("c"), F.max(peaks).alias("d"))
    rows = F.array_distinct(F.array(*(F.struct(F.col(f"{k}.frame").alias("frame"), F.col(f"{k}.value").alias("value")) for k in "abcd")))
    return x.select("panel", "cluster", "kind", F.inline(rows))


def lines(series: DataFrame, path: str, title: str, limits: tuple[float, float] | None = None) -> str:
    """One panel per value of ``panel``, one line per cluster; raw lines are pale."""
    rows = outlined(series).orderBy("panel", "kind", "cluster", "frame").collect()
    panels = sorted({r["panel"] for r in rows}, reverse=True)
    on = page(path, WIDTH, 60 + HEIGHT * len(panels))
    on.text(MARGIN, 20, title)
    for k, panel in enumerate(panels):
        own = [r for r in rows if r["panel"] == panel]
        low, high = limits or (min(0.0, *(r["value"] for r in own)), max(1.0, *(r["value"] for r in own)))
        a, b = min(r["frame"] for r in own), max(r["frame"] for r in own)
        top = 40 + k * HEIGHT
        x = lambda f, a=a, b=b: MARGIN + (f - a) / max(1, b - a) * (WIDTH - 2 * MARGIN)
        y = lambda v, low=low, high=high, top=top: top + (HEIGHT - MARGIN) * (1 - (v - low) / (high - low))
        on.box(MARGIN, top, WIDTH - 2 * MARGIN, HEIGHT - MARGIN)
        for v in (low, high):
            on.text(5, y(v), f"{v:.2f}")
        for f in sorted({a, b}):
            on.text(x(f), top + HEIGHT - MARGIN + 15, str(f))
        for key in sorted({(r["kind"], -1 if r["cluster"] is None else r["cluster"]) for r in own}, reverse=True):
            mine = [r for r in own if (r["kind"], -1 if r["cluster"] is None else r["cluster"]) == key]
            on.line([(x(r["frame"]), y(r["value"])) for r in mine], colour(mine[0]["cluster"]), 1 if key[0] == "line" else 0.3)
    return _write(path, on)


def contact_map(points: DataFrame, stats: dict, path: str) -> str:
    """A square per contact below the diagonal, with the map's numbers."""
    cell = max(2, 700 // (stats["max_residue"] + 1))
    side = cell * (stats["max_residue"] + 1)
    on = page(path, side, side)
    on.line([(0, side), (side, 0)], "#999999", 0.5)
    for r in points.orderBy("x", "y").toLocalIterator():
        on.square(r["x"] * cell - cell / 2, side - r["y"] * cell - cell / 2, cell, colour(r["cluster"]))
    for k, text in enumerate([f"Total contacts: {stats['total']}", f"Clustered: {stats['clustered']}", f"Unassigned: {stats['unassigned']}", f"Below diagonal: {stats['below_diagonal']}", f"Clusters: {stats['clusters']}"]):
        on.text(8, 18 + 16 * k, text)
    return _write(path, on)


#: White, then the clusters' colours.
PALETTE = b"\xff\xff\xff" + b"".join(bytes(rgb(c)) for c in COLOURS) + bytes(3 * (16 - 1 - len(COLOURS)))


def images(points: DataFrame, frames: DataFrame, size: int, code: Callable[[np.ndarray], bytes]) -> DataFrame:
    """data: what ``code`` makes of a frame's image of places in PALETTE, a row per frame, partitions and rows by frame; made by executors."""
    cell = max(1, 400 // (size + 1))
    side = cell * (size + 1)
    drawn = frames.join(points.groupBy("frame").agg(F.collect_list(F.struct("x", "y", "cluster")).alias("points")), "frame", "left").orderBy("frame").select("points")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 100):  # bounded, however large an image is
                out = []
                for own in b.column(0).slice(at, 100).to_pylist():
                    image = np.zeros((side, side), dtype=np.uint8)
                    for p in own or ():
                        x, y = p["x"], p["y"]
                        image[side - y * cell - cell : side - y * cell, x * cell : x * cell + cell] = 1 + index_of(p["cluster"])
                    out.append(code(image))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["data"])

    ship(frames.sparkSession)
    return drawn.mapInArrow(run, "data binary")


def coded(images_: DataFrame) -> Iterator[bytes]:
    """The images' data in order, some at a time, from the files that executors wrote them to."""
    import pyarrow.parquet as pq

    with written_parts(images_, "parquet") as files:
        for file in files:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=256):
                yield from batch.column(0).to_pylist()


def _bits(codes: list[int], widths: list[int]) -> tuple[int, int]:
    """The codes one after the other, lowest bits first, as one number; and its bits."""
    wide = np.array(widths)
    place = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    bits = ((np.repeat(np.array(codes), wide) >> place) & 1).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), len(bits)


@lru_cache(maxsize=1 << 15)
def _band(row: bytes, rows: int, bits: int) -> tuple[int, int, int]:
    """GIF's image code of some equal rows, with a new table: as a number, its bits, and the width of the code that follows.

    The longest known stretch each time, which with the pixel after it gets the next number; at 4096 numbers the table
    begins anew.  All beginnings of a known stretch are known, so the longest one is found by halving.
    """
    data, n, clear = row * rows, rows * len(row), 1 << bits
    single = {bytes([k]): k for k in range(clear)}
    table, new, width, longest, guess = dict(single), clear + 2, bits + 1, 1, 0
    codes, widths, at = [], [], 0
    while at < n:
        low, high = 1, min(longest, n - at) + 1
        while high - low > 1:  # up from the last stretch's length in steps that double, then by halves
            middle = min(high - 1, low + guess) if guess else (low + high) // 2
            if data[at : at + middle] in table:
                low, guess = middle, 2 * guess
            else:
                high, guess = middle, 0
        guess = low // 2
        codes.append(table[data[at : at + low]])
        widths.append(width)
        if new < 4096:
            table[data[at : at + low + 1]] = new
            longest = max(longest, low + 1)
            width += new == 1 << width and width < 12
            new += 1
        else:
            codes.append(clear)
            widths.append(width)
            table, new, width, longest = dict(single), clear + 2, bits + 1, 1
        at += low
    return *_bits(codes, widths), width


def _lzw(pixels: np.ndarray, bits: int = 4) -> bytes:
    """GIF's image code: each stretch of equal rows by itself, since cells are squares and many images have the same ones."""
    clear = 1 << bits
    starts = [0, *(np.flatnonzero((pixels[1:] != pixels[:-1]).any(axis=1)) + 1).tolist()]
    code, size, width = clear, bits + 1, bits + 1
    for a, b in zip(starts, [*starts[1:], len(pixels)], strict=True):
        if a:
            code, size = code | clear << size, size + width
        own, n, width = _band(pixels[a].tobytes(), b - a, bits)
        code, size = code | own << size, size + n
    return (code | (clear + 1) << size).to_bytes((size + width + 7) // 8, "little")


def _gif_image(image: np.ndarray, interval: int) -> bytes:
    side, code = len(image), _lzw(image)
    head = b"\x21\xf9\x04\x00" + struct.pack("<H", max(2, interval // 10)) + b"\x00\x00,\x00\x00\x00\x00" + struct.pack("<HHB", side, side, 0) + b"\x04"
    return head + b"".join(bytes([len(code[k : k + 255])]) + code[k : k + 255] for k in range(0, len(code), 255)) + b"\x00"


def animation(points: DataFrame, frames: DataFrame, size: int, path: str, interval: int = 50) -> str:
    """A GIF with an image per frame, of all frames; executors make the images, here they are only put one after the other."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    side = max(1, 400 // (size + 1)) * (size + 1)
    with open(path, "wb") as f:
        f.write(b"GIF89a" + struct.pack("<HHBBB", side, side, 0xF3, 0, 0) + PALETTE + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
        for data in coded(images(points, frames, size, lambda image: _gif_image(image, interval))):
            f.write(data)
        f.write(b";")
    return path


def images_in(path: str) -> tuple[int, int]:
    """How many images a GIF or MP4 of ours has, and their side; what is held is a block, of an MP4 also the images' sizes."""
    with open(path, "rb") as f:
        if (head := f.read(13)).startswith(b"GIF89a"):
            count = 0
            f.seek(3 * 16, os.SEEK_CUR)
            while (kind := f.read(1)) not in (b";", b""):
                count += kind == b","
                f.seek({b"!": 1, b",": 10}[kind], os.SEEK_CUR)
                while n := f.read(1)[0]:
                    f.seek(n, os.SEEK_CUR)
            return count, int.from_bytes(head[6:8], "little")
        f.seek(int.from_bytes(head[:4], "big") + 8)
        f.seek(int.from_bytes(f.read(8), "big") - 16, os.SEEK_CUR)
        tables = f.read()
        f.seek(int.from_bytes(head[:4], "big") + 16)
        first = f.read(24)
        at = tables.rindex(b"stsz")
        return int.from_bytes(tables[at + 12 : at + 16], "big"), int.from_bytes(first[16:20], "big")


def _atom(name: bytes, *parts: bytes) -> bytes:
    data = b"".join(parts)
    return struct.pack(">I", len(data) + 8) + name + data


def movie(points: DataFrame, frames: DataFrame, size: int, path: str, fps: int = 20) -> str:
    """An MP4 with an image per frame, of all frames, each a PNG: a stream kind that MP4 has a number for (0x6D) and that needs no video encoder.

    Executors make the images; what is held here beside some of them is the size of each.
    """
    sizes, side = [], max(1, 400 // (size + 1)) * (size + 1)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    kind = _atom(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    with open(path, "wb") as f:
        f.write(kind + struct.pack(">I4sQ", 1, b"mdat", 0))
        for data in coded(images(points, frames, size, lambda image: png(image, PALETTE))):
            sizes.append(len(data))
            f.write(data)
        f.seek(len(kind) + 8)
        f.write(struct.pack(">Q", 16 + sum(sizes)))
        f.seek(0, os.SEEK_END)
        n, zeros, unit = len(sizes), bytes, struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
        stream = b"\x03\x15\x00\x01\x00" + b"\x04\x0d\x6d\x11" + zeros(11)  # of one elementary stream: PNG images, visual
        entry = _atom(b"mp4v", zeros(6), struct.pack(">H", 1), zeros(16), struct.pack(">HHIIIH", side, side, 0x480000, 0x480000, 0, 1), zeros(32), struct.pack(">Hh", 24, -1), _atom(b"esds", zeros(4), stream))
        table = _atom(b"stbl", _atom(b"stsd", zeros(4), struct.pack(">I", 1), entry), _atom(b"stts", zeros(4), struct.pack(">III", 1, n, 1)), _atom(b"stsc", zeros(4), struct.pack(">IIII", 1, 1, max(1, n), 1)),
                      _atom(b"stsz", zeros(4), struct.pack(">II", 0, n), struct.pack(f">{n}I", *sizes)), _atom(b"co64", zeros(4), struct.pack(">IQ", 1, len(kind) + 16)))
        where = _atom(b"dinf", _atom(b"dref", zeros(4), struct.pack(">I", 1), _atom(b"url ", b"\x00\x00\x00\x01")))
        media = _atom(b"mdia", _atom(b"mdhd", zeros(12), struct.pack(">IIHH", fps, n, 0x55C4, 0)), _atom(b"hdlr", zeros(8), b"vide", zeros(13)), _atom(b"minf", _atom(b"vmhd", b"\x00\x00\x00\x01", zeros(8)), where, table))
        track = _atom(b"trak", _atom(b"tkhd", b"\x00\x00\x00\x03", zeros(8), struct.pack(">III", 1, 0, n), zeros(16), unit, struct.pack(">II", side << 16, side << 16)), media)
        f.write(_atom(b"moov", _atom(b"mvhd", zeros(12), struct.pack(">IIIH", fps, n, 0x10000, 0x100), zeros(10), unit, zeros(24), struct.pack(">I", 2)), track))
    return path
