"""Media columns: TIFF files, one row per page. Strips and tiles; PackBits, LZW and deflate; the predictors of integers
and floats; samples of 1 to 32 bits, side by side or in planes; both byte and fill orders. A plain writer is beside
the reader."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, map_batches, slices
from .util import struct as struct_

# TIFF 6.0 tags, types (bytes of one value), compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST = 256, 257, 258
SAMPLE_FORMAT, FILL_ORDER = 339, 266
#: LZW codes by how many came since the clear code: bits of each, and places of their first bits. The table grows by
#: one with each code but the first, up to 4,096 entries; so many codes may come between clear codes at most.
WIDTHS = np.minimum(12, np.array([(FIRST + k).bit_length() for k in range(1 << 16)]))
STARTS = np.concatenate([[0], np.cumsum(WIDTHS)])
RUN = re.compile(rb"(.)\1{2,127}", re.S)
REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel().tobytes()

#: Pages of a file and bytes of a page that are decoded at most before the file counts as broken: directories can
#: be chained in circles, and a header may claim any size.
MAX_PAGES, MAX_PAGE_BYTES = 65_536, 1 << 31


class Broken(ValueError):
    """The file contradicts the format; the row of the page says how."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes, and what stands between them as it is, in packets of 128 at most."""
    out, at = bytearray(), 0
    for run in RUN.finditer(data):
        for k in range(at, run.start(), 128):
            part = data[k : min(k + 128, run.start())]
            out.append(len(part) - 1)
            out += part
        out += bytes((257 - len(run[0]), run[0][0]))
        at = run.end()
    for k in range(at, len(data), 128):
        out.append(len(data[k : k + 128]) - 1)
        out += data[k : k + 128]
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early, as the format has it. How wide a code is
    follows from how many came since the last clear code, so that all codes up to the next are taken at once."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    held, start, out, total = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32), 0, [], 0
    while total < size:
        ends = start + STARTS[: (8 * len(data) - start) // 9 + 2]
        n = int(np.searchsorted(ends[1:], 8 * len(data), "right"))
        if not n:
            break
        byte, shift = ends[:n] >> 3, (ends[:n] & 7).astype(np.uint32)
        words = held[byte] << 16 | held[byte + 1] << 8 | held[byte + 2]
        codes = words >> (24 - shift - WIDTHS[:n]) & ((1 << WIDTHS[:n]) - 1)
        stop = np.nonzero((codes == CLEAR) | (codes == END))[0]
        here = int(stop[0]) if len(stop) else n
        table, last = list(base), None
        add, found = table.append, table.__getitem__
        for code in codes[:here].tolist():
            if last is None:
                if code >= 256:
                    raise Broken("an LZW strip starts with an unknown code")
                last = found(code)
            else:
                if code > len(table):
                    raise Broken("an LZW code is ahead of its table")
                word = found(code) if code < len(table) else last + last[:1]
                if len(table) < 4096:
                    add(last + word[:1])
                last = word
            out.append(last)
            total += len(last)
        if here == n or codes[here] == END:
            break
        start = int(ends[here + 1])
    return b"".join(out)[:size]


def pack_lzw(data: bytes) -> bytes:
    codes, since, at = [CLEAR], [0], 1  # since: places of the clear codes
    table: dict[int, int] = {}
    following, code = FIRST, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = table.get(code << 8 | byte)
        if longer is not None:
            code = longer
            continue
        codes.append(code)
        at += 1
        table[code << 8 | byte] = following
        following += 1
        if following == 4095:  # before the reader's table could need 13 bits
            codes.append(CLEAR)
            since.append(at)
            at += 1
            table, following = {}, FIRST
        code = byte
    if code >= 0:
        codes.append(code)
    codes.append(END)
    all_codes = np.array(codes, np.uint32)
    widths = np.empty(len(codes), np.int64)
    widths[0] = 9
    for s, e in zip(since, [*since[1:], len(codes)], strict=True):  # a clear code is as wide as what it ends
        own = widths[s + 1 : e + 1]
        own[:] = WIDTHS[: len(own)]
    bits = all_codes[:, None] >> np.arange(11, -1, -1, np.uint32) & 1
    return np.packbits(bits[np.arange(12) >= 12 - widths[:, None]].astype(np.uint8)).tobytes()


def decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise Broken(f"deflate: {e}") from e
    raise Broken(f"compression {compression} is not known")


def encode(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 6)}[compression](data)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Of each image directory the byte order and its tags' values."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise Broken("not a TIFF file")
    at, seen = struct.unpack(f"{order}I", data[4:8])[0], set()
    while at:
        if at in seen or len(seen) >= MAX_PAGES:
            raise Broken("the image directories run in a circle")
        seen.add(at)
        try:
            n = struct.unpack_from(f"{order}H", data, at)[0]
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
                if kind not in TYPE_BYTES:
                    continue
                where = at + 2 + 12 * k + 8
                if TYPE_BYTES[kind] * count > 4:
                    where = struct.unpack_from(f"{order}I", data, where)[0]
                if kind in (1, 3, 4):
                    if where + TYPE_BYTES[kind] * count > len(data):
                        raise Broken(f"tag {tag} lies outside the file")
                    tags[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, where)
            at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]
        except struct.error as e:
            raise Broken("an image directory is cut off") from e
        yield order, tags


def samples(raw: bytes, bits: int, kind: np.dtype, rows: int, width: int, n: int, predictor: int, order: str) -> np.ndarray:
    """A strip's or tile's samples, [rows, width, n], with the predictor undone."""
    if bits < 8:  # rows start at whole bytes
        flat = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : width * n * bits].reshape(rows, width * n, bits)
        return (flat << np.arange(bits - 1, -1, -1, np.uint8)).sum(axis=2, dtype=np.uint8).reshape(rows, width, n)
    if predictor == 3:  # differences of bytes, the highest of all samples of a row first
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, n), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, n).astype(kind.newbyteorder("="))
    block = np.frombuffer(raw, kind.newbyteorder(order)).reshape(rows, width, n).astype(kind.newbyteorder("="))
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def read_page(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    """[height, width, samples]: samples of 1, 2, 4 or 8 bits as bytes, of 16 or 32 bits as unsigned numbers or floats."""
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, n = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height or not n:
        raise Broken("a page has no size")
    depths, format_, predictor = set(tags.get(BITS, (1,))), one(SAMPLE_FORMAT, 1), one(PREDICTOR, 1)
    bits = next(iter(depths))
    kind = {(1, 1): "u1", (2, 1): "u1", (4, 1): "u1", (8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (16, 3): "f2", (32, 3): "f4"}.get((bits, format_))
    if len(depths) != 1 or kind is None:
        raise Broken(f"{sorted(depths)} bits a sample of format {format_}: not read here")
    if predictor not in (1, 2, 3) or predictor == 2 and (bits < 8 or format_ == 3) or predictor == 3 and format_ != 3:
        raise Broken(f"predictor {predictor} is not known for {bits} bits of format {format_}")
    kind, apart = np.dtype(kind), one(PLANAR, 1) == 2
    if width * height * n * kind.itemsize > MAX_PAGE_BYTES:
        raise Broken("a page claims too large a size")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if not w or not h or w * h * n * kind.itemsize > MAX_PAGE_BYTES:
        raise Broken("strips or tiles without a size, or too large")
    offsets, counts = (tags.get(TILE_OFFSETS, ()), tags.get(TILE_COUNTS, ())) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ()))
    across, down, planes = -(-width // w), -(-height // h), n if apart else 1
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise Broken("strips or tiles are missing")
    page = np.zeros((height, width, n), kind)
    own = 1 if apart else n
    for k in range(across * down * planes):
        plane, at = divmod(k, across * down)
        y, x = at // across * h, at % across * w
        rows = h if tiled else min(h, height - y)
        size = rows * -(-w * own * bits // 8)
        raw = data[offsets[k] : offsets[k] + counts[k]]
        raw = decode(raw.translate(REVERSED) if one(FILL_ORDER, 1) == 2 else raw, one(COMPRESSION, NONE), size)
        if len(raw) < size:
            raise Broken(f"strip or tile {k} is too short")
        block = samples(raw, bits, kind, rows, w, own, predictor, order)
        page[y : y + rows, x : x + w, plane : plane + own] = block[: height - y, : width - x]
    return page


def write_tiff(pages: list[np.ndarray], forms: list[tuple[int, int, tuple[int, int] | None]] | None = None, rows: int = 1024, order: str = "<") -> bytes:
    """A file of [height, width(, samples)] pages of uint8, uint16 or float32 samples; each page's form is its
    compression, predictor and tile, (width, height), both multiples of 16, or None for strips of `rows`."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page, (compression, predictor, tile) in zip(pages, forms or [(DEFLATE, 1, None)] * len(pages), strict=True):
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, n = page.shape
        if tile:
            w, h = tile
            full = np.zeros((-(-height // h) * h, -(-width // w) * w, n), page.dtype)
            full[:height, :width] = page
            blocks = [full[y : y + h, x : x + w] for y in range(0, full.shape[0], h) for x in range(0, full.shape[1], w)]
        else:
            blocks = [page[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1]))
            raw = np.ascontiguousarray(b.astype(page.dtype.newbyteorder(order))).tobytes()
            if predictor == 3:
                planes = np.ascontiguousarray(b.astype(page.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(b), -1, page.dtype.itemsize).transpose(0, 2, 1)
                flat = planes.reshape(len(b), -1, n)
                raw = np.diff(flat, axis=1, prepend=np.zeros_like(flat[:, :1])).tobytes()
            coded = encode(raw, compression)
            offsets.append(len(out))
            counts.append(len(coded))
            out += coded + b"\0" * (len(coded) % 2)
        tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [page.dtype.itemsize * 8] * n), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1 if n < 3 else 2]), SAMPLES: (3, [n]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor]), SAMPLE_FORMAT: (3, [3 if page.dtype.kind == "f" else 1] * n)}
        tags |= {TILE_WIDTH: (4, [tile[0]]), TILE_HEIGHT: (4, [tile[1]]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [rows]), STRIP_COUNTS: (4, counts)}
        entries = b""
        for tag in sorted(tags):
            kind, values = tags[tag]
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                raw, place = struct.pack(f"{order}I", len(out)), raw
                out += place + b"\0" * (len(place) % 2)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def feature(page: np.ndarray) -> str:
    """Size, mean, spread and entropy of the samples, and how much neighbours along a row differ."""
    flat = page.reshape(-1)
    n = np.bincount(flat) if page.dtype.itemsize < 4 and page.dtype.kind == "u" else np.unique(flat, return_counts=True)[1]
    n = n[n > 0] / len(flat)
    step = np.abs(np.diff(page.astype(np.float64 if page.dtype.kind == "f" else np.int64), axis=1)).mean() if page.shape[1] > 1 else 0.0
    return f"w={page.shape[1]};h={page.shape[0]};s={page.shape[2]};mean={flat.mean():.4f};std={flat.std():.4f};entropy={-(n * np.log2(n)).sum() + 0.0:.4f};step={step:.4f}"


PAGES = "page int, width int, height int, samples int, bits int, feature string, pixels binary, error string"


def tiff_pages(media: DataFrame, keep: list[str], column: str = "media", pixels: bool = True) -> DataFrame:
    """The columns in `keep` and one row per page: page (from 0), width, height, samples, bits, feature, pixels (the
    samples row by row in the machine's order, null unless asked for) and error; all of these begin with `tiff_` if a
    kept column has one of their names. A page or file that can't be read gives one row with the reason in error and
    nulls else; pages before it stay. Null media give no rows, an empty table none; repeated rows repeat theirs."""
    names = struct_(PAGES).names
    before = "tiff_" if set(keep) & set(names) else ""
    ddl = ", ".join([*(f"k{i} {media.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), PAGES])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            own = [b.column(k).to_pylist() for k in range(len(keep))]
            for row in range(b.num_rows):  # a page at a time: pages may be large
                data = b.column(len(keep))[row].as_py()
                for page in () if data is None else pages_of(data, pixels):
                    yield {f"k{k}": [own[k][row]] for k in range(len(keep))} | {k: [v] for k, v in page.items()}

    chosen = media.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("media"))
    return map_batches(chosen, run, ddl).toDF(*keep, *[before + c for c in names])


def pages_of(data: bytes, pixels: bool = True) -> Iterator[dict]:
    at, walk = 0, directories(data)
    empty = dict.fromkeys(("width", "height", "samples", "bits", "feature", "pixels", "error"))
    while True:
        try:
            order, tags = next(walk)
            p = read_page(data, order, tags)
            yield {"page": at, "width": p.shape[1], "height": p.shape[0], "samples": p.shape[2], "bits": p.dtype.itemsize * 8, "feature": feature(p), "pixels": p.tobytes() if pixels else None, "error": None}
        except StopIteration:
            return
        except Broken as e:
            yield {"page": at} | empty | {"error": str(e)}
            if walk.gi_frame is None:
                return
        at += 1


#: Width of the images that hold texts, and rows of a page: longer texts go on on the next page.
ROW, PAGE_ROWS = 64, 1024
#: What a text's pages are stored with, in turn: compression, predictor, tile. A hash of the text says which comes first.
FORMS = ((LZW, 1, None), (PACKBITS, 1, None), (DEFLATE, 2, None), (DEFLATE, 1, (ROW, 32)), (LZW, 1, (ROW, 32)))


def text_image(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and the TIFF file that holds them, zero-padded to whole rows. A hash of the text, not its size,
    chooses the forms of its pages, so equal texts give equal files."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    page = np.frombuffer(raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\0"), np.uint8).reshape(-1, ROW)
    first = zlib.crc32(raw)
    pages = [page[at : at + PAGE_ROWS] for at in range(0, len(page), PAGE_ROWS)]
    return len(raw), write_tiff(pages, [FORMS[(first + k) % len(FORMS)] for k in range(len(pages))], order="<>"[first // len(FORMS) % 2])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each text becomes a TIFF file, stored as a column of a table in the shared folder; all but n_bytes comes from
    the table as read back. Null and empty texts are one row of 64 zero bytes. Repeated rows give repeated rows;
    no rows give no rows; a null doc_id stays null; other columns are ignored, whatever their names."""

    def store(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, 256):
            made = [text_image(t) for t in part.column(1).to_pylist()]
            yield {"doc_id": part.column(0), "n_bytes": [n for n, _ in made], "media": [m for _, m in made]}

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored, _ = cut(map_batches(base, store, "doc_id long, n_bytes long, media binary"), "media")

    def back(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, 256):
            rows: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in b.column(2).to_pylist():
                pages = list(pages_of(data))
                if any(p["error"] for p in pages):
                    raise Broken(pages[-1]["error"])
                payload = b"".join(p["pixels"] for p in pages)
                got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), "|".join(p["feature"] for p in pages))
                for k, v in zip(rows, got, strict=True):
                    rows[k].append(v)
            yield {"doc_id": b.column(0), "n_bytes": b.column(1)} | rows

    return map_batches(stored, back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
