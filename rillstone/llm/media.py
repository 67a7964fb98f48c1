"""Operator 2: media columns. Netpbm and BMP images become numpy arrays, tiles of one size and difference hashes.

Tiles are means over areas, read from an integral image in whole numbers only: the sum up to a fraction of a pixel
is a weighted mean of four entries of the integral image, scaled by the tile's height and width, so that equal images
have equal tiles everywhere. Of the integral image only the entries at the borders of areas are kept, and it is made
in bands, so that large images take little more memory than their pixels. A tile is stored as the bytes of an NPY file.
"""

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick, shared_dir

#: Height and width of a tile, and samples that are widened at once.
TILE, BAND = 32, 1 << 20
HASH_ROWS, HASH_COLUMNS = 8, 9
SCHEMA = "doc_id long, format string, width int, height int, channels int, dhash string, npy binary, error string"
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")
_SPACE = re.compile(rb"\s")
_KINDS = {b"P1": ("pbm", 1), b"P2": ("pgm", 1), b"P3": ("ppm", 3), b"P4": ("pbm", 1), b"P5": ("pgm", 1), b"P6": ("ppm", 3)}


class BadImage(ValueError):
    """The bytes aren't an image of a known kind, or end too early."""


def _checked(width: int, height: int) -> None:
    if width < 1 or height < 1:
        raise BadImage("no pixels")


def _there(data: bytes, at: int, size: int) -> None:
    """Before anything is allocated: are there ``size`` bytes from ``at`` on?"""
    if not 0 <= at <= len(data) - size:
        raise BadImage("too short")


def _numbers(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """Decimal numbers of a header; comments run from # to the line's end."""
    found = []
    while len(found) < count:
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit() or len(m[1]) > 9:
            raise BadImage("bad header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def _eight_bits(values: np.ndarray, most: int) -> np.ndarray:
    """0..most to 0..255, rounded half up; larger values count as ``most``."""
    if most == 255 and values.dtype == np.uint8:
        return values
    flat = values.reshape(-1)
    out = np.empty(len(flat), np.uint8)
    for a in range(0, len(flat), BAND):
        wide = np.minimum(flat[a : a + BAND].astype(np.int64), most)
        out[a : a + BAND] = (wide * 510 + most) // (2 * most)
    return out.reshape(values.shape)


def _decimal(word: bytes) -> int:
    word = word.lstrip(b"0")
    return int(word or b"0") if len(word) < 6 else 65535


def _decimals(body: bytes, count: int) -> np.ndarray:
    """The first ``count`` numbers of a text, a band at a time; those above 65535, as any maximum is, count as 65535."""
    out, done, at = np.zeros(count, np.uint16), 0, 0
    while done < count and at < len(body):
        space = _SPACE.search(body, at + BAND)
        end = space.start() if space else len(body)
        words = body[at:end].split()[: count - done]
        if not all(w.isdigit() for w in words):
            raise BadImage("bad sample")
        short = max(map(len, words), default=0) < 10
        out[done : done + len(words)] = np.minimum(np.array(words, "S9").astype(np.int64) if short else [_decimal(w) for w in words], 65535)
        done, at = done + len(words), end
    if done < count:
        raise BadImage("too short")
    return out


def netpbm(data: bytes) -> tuple[str, np.ndarray]:
    """Kind and pixels (height, width, channels) as bytes, of P1 to P7. Black is 0."""
    magic = data[:2]
    if magic == b"P7":
        return _pam(data)
    kind, channels = _KINDS[magic]
    bitmap = channels == 1 and kind == "pbm"
    head, at = _numbers(data, 2, 2 if bitmap else 3)
    width, height = head[:2]
    _checked(width, height)
    most = 1 if bitmap else head[2]
    if not 1 <= most <= 65535:
        raise BadImage("bad maximum")
    count = width * height * channels
    if magic == b"P1":  # digits may stand without white space between
        _there(data, at, count)
        body = np.frombuffer(re.sub(rb"#[^\r\n]*", b"", data[at:]), np.uint8)
        values = body[(body == 48) | (body == 49)][:count] - 48
    elif magic in (b"P2", b"P3"):
        _there(data, at, 2 * count)  # white space and a digit
        values = _decimals(re.sub(rb"#[^\r\n]*", b"", data[at:]) if b"#" in data[at:] else data[at:], count)
    elif magic == b"P4":
        stride = -(-width // 8)
        _there(data, at + 1, stride * height)
        body = np.frombuffer(data, np.uint8, stride * height, at + 1)
        values = np.unpackbits(body.reshape(height, stride), axis=1, count=width).ravel()
    else:
        wide = 2 if most > 255 else 1
        _there(data, at + 1, count * wide)
        values = np.frombuffer(data, ">u2" if wide == 2 else np.uint8, count, at + 1)
    if len(values) < count:
        raise BadImage("too short")
    if bitmap:
        values = 1 - values  # a set bit is black
    return kind, _eight_bits(values, most).reshape(height, width, channels)


def _pam(data: bytes) -> tuple[str, np.ndarray]:
    end = data.find(b"ENDHDR\n")
    if end < 0:
        raise BadImage("bad header")
    fields = dict(x.split(None, 1) for x in data[2:end].splitlines() if len(x.split(None, 1)) == 2 and not x.startswith(b"#"))
    try:
        width, height, depth, most = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    except (KeyError, ValueError) as e:
        raise BadImage("bad header") from e
    _checked(width, height)
    if not 1 <= depth <= 4 or not 1 <= most <= 65535:
        raise BadImage("bad header")
    wide, count = 2 if most > 255 else 1, width * height * depth
    _there(data, end + 7, count * wide)
    values = np.frombuffer(data, ">u2" if wide == 2 else np.uint8, count, end + 7)
    colour = depth if depth in (1, 3) else depth - 1  # without transparency
    return "pam", np.ascontiguousarray(_eight_bits(values, most).reshape(height, width, depth)[:, :, :colour])


def _runs(data: bytes, at: int, width: int, height: int, nibbles: bool) -> np.ndarray:
    """Run-length coded palette indices, bottom row first. Two bytes set 255 pixels at most; more than all bytes could set is too short."""
    if width * height > 128 * max(0, len(data) - at):
        raise BadImage("too short")
    out = np.zeros((height, width), np.uint8)
    x = y = 0
    while y < height and at + 1 < len(data):
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            pair = (v >> 4, v & 15) if nibbles else (v, v)
            run = np.array(pair, np.uint8)[np.arange(n) % 2]
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            if at + 1 >= len(data):
                break
            x, y = x + data[at], y + data[at + 1]
            at += 2
            continue
        else:
            size = (v + 1) // 2 if nibbles else v
            raw = np.frombuffer(data[at : at + size], np.uint8)
            run = np.stack((raw >> 4, raw & 15), axis=1).ravel()[:v] if nibbles else raw
            at += size + size % 2
        room = max(0, min(len(run), width - x))
        out[y, x : x + room] = run[:room]
        x += len(run)
    return out


def bmp(data: bytes) -> tuple[str, np.ndarray]:
    """Pixels of a Windows bitmap: 1, 4, 8, 16, 24 or 32 bits, run lengths and bit fields; grey if its palette is grey."""
    word = lambda i, n=4, signed=False: int.from_bytes(data[i : i + n], "little", signed=signed)
    if len(data) < 26:
        raise BadImage("too short")
    begin, size = word(10), word(14)
    if size == 12:
        width, height, bits, packed, colours, entry = word(18, 2), word(20, 2), word(24, 2), 0, 0, 3
    elif size >= 40 and len(data) >= 54:
        width, height, bits, packed, colours, entry = word(18, signed=True), word(22, signed=True), word(28, 2), word(30), word(46), 4
    else:
        raise BadImage("bad header")
    upward, height = height > 0, abs(height)
    _checked(width, height)
    if bits <= 8:
        if bits not in (1, 4, 8):
            raise BadImage("bad depth")
        n = min(colours or 1 << bits, 1 << bits)
        table = np.frombuffer(data[14 + size : 14 + size + n * entry], np.uint8)
        palette = np.zeros((256, 3), np.uint8)
        palette[: len(table) // entry] = table[: len(table) // entry * entry].reshape(-1, entry)[:, 2::-1]
        if packed in (1, 2):
            index = _runs(data, begin, width, height, packed == 2)
        else:
            rows = _rows(data, begin, width, height, bits)
            index = rows[:, :width] if bits == 8 else np.unpackbits(rows, axis=1, count=width) if bits == 1 else np.stack((rows >> 4, rows & 15), axis=2).reshape(height, -1)[:, :width]
        grey = bool((palette[: max(n, 1)] == palette[: max(n, 1), :1]).all())
        pixels = palette[index][:, :, :1] if grey else palette[index]
    elif bits in (24, 32) and packed == 0:
        rows = _rows(data, begin, width, height, bits)
        pixels = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    elif bits in (16, 32) and packed in (0, 3):
        masks = [word(54 + 4 * i) for i in range(3)] if packed == 3 else [0x7C00, 0x3E0, 0x1F]
        if not all(masks) or any((m >> (m & -m).bit_length() - 1) + 1 & m >> (m & -m).bit_length() - 1 for m in masks):
            raise BadImage("bad masks")
        rows = np.ascontiguousarray(_rows(data, begin, width, height, bits)[:, : width * bits // 8])
        values = rows.view("<u2" if bits == 16 else "<u4")
        pixels = np.empty((height, width, 3), np.uint8)
        for i, m in enumerate(masks):
            low = (m & -m).bit_length() - 1
            pixels[:, :, i] = _eight_bits((values & values.dtype.type(m & (1 << bits) - 1)) >> values.dtype.type(low), m >> low)
    else:
        raise BadImage("unknown packing")
    return "bmp", np.ascontiguousarray(pixels[::-1] if upward else pixels)


def _rows(data: bytes, begin: int, width: int, height: int, bits: int) -> np.ndarray:
    stride = (width * bits + 31) // 32 * 4
    _there(data, begin, stride * height)
    if begin < 14:
        raise BadImage("bad header")
    return np.frombuffer(data, np.uint8, stride * height, begin).reshape(height, stride)


def decode(data: bytes) -> tuple[str, np.ndarray]:
    """Kind and pixels (height, width, 1 or 3) in 8 bits. Raises BadImage."""
    if data[:2] == b"BM":
        return bmp(data)
    if data[:2] in _KINDS or data[:3] == b"P7\n":
        return netpbm(data)
    raise BadImage("unknown kind")


def grey(pixels: np.ndarray) -> np.ndarray:
    """One channel: luma in thousandths, rounded half up."""
    if pixels.shape[2] == 1:
        return pixels
    flat = pixels.reshape(-1, 3)
    out = np.empty(len(flat), np.uint8)
    for a in range(0, len(flat), BAND):
        out[a : a + BAND] = (flat[a : a + BAND].astype(np.int32) @ np.array([299, 587, 114], np.int32) + 500) // 1000
    return out.reshape(*pixels.shape[:2], 1)


def _up_to(size: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the borders of ``parts`` areas of equal size: whole pixels before, the rest in parts of a pixel, and all positions needed."""
    at = np.arange(parts + 1, dtype=np.int64) * size
    whole, rest = at // parts, at % parts
    return whole, rest, np.unique(np.concatenate((whole, np.minimum(whole + 1, size))))


def _prefixes(band: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Sums of the first need[i] pixels of each line of a band (lines, width, channels)."""
    out = np.zeros((band.shape[0], len(need), band.shape[2]), np.int64)
    before = np.zeros((band.shape[0], 1, band.shape[2]), np.int64)
    step = max(1, BAND // (band.shape[0] * band.shape[2]))
    for x in range(0, band.shape[1], step):
        sums = np.cumsum(band[:, x : x + step], axis=1, dtype=np.int64) + before
        inside = (need > x) & (need <= x + step)
        out[:, inside] = sums[:, need[inside] - x - 1]
        before = sums[:, -1:]
    return out


def integral(pixels: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """The integral image at ascending lines ``ys`` and columns ``xs``."""
    height, width, channels = pixels.shape
    out = np.zeros((len(ys), len(xs), channels), np.int64)
    before = np.zeros((1, len(xs), channels), np.int64)
    step = max(1, BAND // (width * channels))
    for y in range(0, height, step):
        sums = np.cumsum(_prefixes(pixels[y : y + step], xs), axis=0) + before
        inside = (ys > y) & (ys <= y + step)
        out[inside] = sums[ys[inside] - y - 1]
        before = sums[-1:]
    return out


def resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over the areas that the target's pixels cover, in whole numbers, rounded half up."""
    height, width, _ = pixels.shape
    (y, y_rest, ys), (x, x_rest, xs) = _up_to(height, rows), _up_to(width, columns)
    table = integral(pixels, ys, xs)
    at, after = np.searchsorted(ys, y), np.searchsorted(ys, np.minimum(y + 1, height))
    sums = table[at] * (rows - y_rest)[:, None, None] + table[after] * y_rest[:, None, None]
    at, after = np.searchsorted(xs, x), np.searchsorted(xs, np.minimum(x + 1, width))
    sums = sums[:, at] * (columns - x_rest)[None, :, None] + sums[:, after] * x_rest[None, :, None]
    part = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    area = height * width
    return ((2 * part + area) // (2 * area)).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 9 grey areas is brighter than the one to its left."""
    small = resize(grey(pixels), HASH_ROWS, HASH_COLUMNS)[:, :, 0]
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), (1, 0), allow_pickle=False)
    return out.getvalue()


def looked_at(data: bytes | None, tile: int) -> tuple:
    """(format, width, height, channels, dhash, npy, error) of one image."""
    if data is None:
        return (None, None, None, None, None, None, "null")
    try:
        kind, pixels = decode(data)
    except BadImage as e:
        return (None, None, None, None, None, None, str(e))
    except (ValueError, IndexError, OverflowError):  # what numpy says of bytes that no format foresees
        return (None, None, None, None, None, None, "bad image")
    height, width, channels = pixels.shape
    return (kind, width, height, channels, difference_hash(pixels), npy(resize(pixels, tile, tile)), None)


def seen(tile: int):
    """Rows (doc_id, image) to SCHEMA, in parts of a few megabytes of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
        names = ["doc_id", "format", "width", "height", "channels", "dhash", "npy", "error"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [looked_at(x.as_py(), tile) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return run


def media_tiles(images: DataFrame, tile: int = TILE, id_column: str = "doc_id", image_column: str = "image") -> DataFrame:
    """(doc_id, format, width, height, channels, dhash, npy, error): one row for each row of the input.

    ``npy`` holds an NPY file of uint8 (tile, tile, 1 or 3). Null, empty, cut and unknown images have an ``error`` that
    tells why and null in all other columns but doc_id; an image is cut if its header claims more pixels than its bytes can
    hold. There is no largest size. Bytes after an image are ignored, samples above the maximum
    count as the maximum. Transparency is dropped. Repeated rows give repeated results; null doc_ids stay null; of equal
    neighbours the hash has a 0 bit. Other columns may have any names and don't show. An empty table gives no rows.
    """
    rows = pick(images, doc_id=id_column, image=image_column).select(F.col("doc_id").cast("long"), F.col("image").cast("binary"))
    return rows.mapInArrow(seen(tile), SCHEMA)


def stacked(path: str, tile: int):
    """Rows (doc_id, channels, npy) to stacks of tiles in NPY files below ``path`` and the place of each row in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        from pyspark import TaskContext

        task = TaskContext.get()
        where, base = fs.FileSystem.from_uri(path)
        for i, batch in enumerate(batches):
            for channels in (1, 3):
                part = batch.filter(pa.array([c == channels for c in batch.column(1).to_pylist()], pa.bool_()))
                if not part.num_rows:
                    continue
                # a task that is run again writes the same bytes under the same name
                name = f"tiles-{task.partitionId():06d}-{i:05d}-{channels}.npy"
                stack = np.stack([np.load(io.BytesIO(x.as_py())) for x in part.column(2)])
                with where.open_output_stream(f"{base}/{name}") as f:
                    f.write(npy(stack))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * part.num_rows), pa.array(np.arange(part.num_rows, dtype=np.int32))], ["doc_id", "file", "row"])

    return run


def write_tiles(tiles: DataFrame, path: str, tile: int = TILE) -> DataFrame:
    """Writes the tiles as NPY stacks, one for each Arrow batch and number of channels, and returns (doc_id, file, row).

    ``path`` must be a folder that all executors share; its index is written beside the stacks as Parquet and read back,
    so that the stacks are written once. Rows with an error have no tile.
    """
    spark = tiles.sparkSession
    shared_dir(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    uri = str(files.makeQualified(hadoop).toUri())
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    tiles.where("error is null").select("doc_id", "channels", "npy").mapInArrow(stacked(uri, tile), "doc_id long, file string, row int").write.mode("overwrite").parquet(f"{path}/index.parquet")
    return spark.read.parquet(f"{path}/index.parquet")


def _bitmap(pixels: np.ndarray) -> bytes:
    """A 24-bit BMP, bottom row first."""
    height, width, _ = pixels.shape
    stride = (width * 24 + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    u = lambda x, n=4: int(x).to_bytes(n, "little")
    return b"BM" + u(54 + rows.size) + u(0) + u(54) + u(40) + u(width) + u(height) + u(1, 2) + u(24, 2) + u(0) + u(rows.size) + u(2835) * 2 + u(0) * 2 + rows.tobytes()


def drawn(text: bytes, kind: int) -> bytes:
    """All bytes of a text as the samples of an image, a little wider than high; kinds 0 to 3 are PGM, PPM, BMP and PBM."""
    channels = 3 if kind in (1, 2) else 1
    per_row = 8 if kind == 3 else 1  # pixels in a byte of a bitmap row
    units = max(1, -(-len(text) // channels))
    width = int(np.ceil(np.sqrt(units)))
    height = -(-units // width)
    body = text.ljust(width * height * channels, b"\0")
    if kind == 0:
        return b"P5\n%d %d\n255\n" % (width, height) + body
    if kind == 1:
        return b"P6\n%d %d\n255\n" % (width, height) + body
    if kind == 3:
        return b"P4\n%d %d\n" % (width * per_row, height) + body
    return _bitmap(np.frombuffer(body, np.uint8).reshape(height, width, 3))


def pictured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, image); the kind of image follows the number of the row's doc_id."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            images = [None if t is None else drawn(t.encode(), (i or 0) % 4) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], ["doc_id", "image"])


def pictures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, image): each whole text drawn as an image, for tables that have texts only. Null texts have null images."""
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(pictured, "doc_id long, image binary")
