"""Media columns: payloads stored as baseline JPEG and read back as DC-only thumbnails."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from trialweave.functions.ship import map_arrow
from trialweave.llm.common import small_batches

#: Payload bytes in a thumbnail's row; rows in one image, by JPEG's 16-bit height.
WIDTH, MOST_ROWS = 192, 65535 // 8
#: Code lengths of the DC size categories 0 to 8, chosen for text; sizes 7, 4, 3 and 2 are frequent.
DC_LENGTHS = (4, 4, 3, 3, 2, 4, 5, 2, 6)
#: The DC quantiser: a block of one value v has the DC coefficient 8 * (v - 128).
QUANTISER = 8


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """JPEG's codes, (code, length) by symbol, for code lengths by symbol."""
    code, last, out = 0, 0, {}
    for symbol, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= length - last
        out[symbol] = (code, length)
        code, last = code + 1, length
    return out


def table_segment(kind: int, lengths: dict[int, int]) -> bytes:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    body = bytes([kind]) + counts + bytes(symbols)
    return b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    """All segments up to the scan of an image of ``rows`` x ``WIDTH`` blocks, one restart interval a row."""
    size = (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big")
    return b"".join((
        b"\xff\xd8", b"\xff\xdb\x00\x43\x00", bytes([QUANTISER] * 64), b"\xff\xc0\x00\x0b\x08", size, b"\x01\x01\x11\x00",
        table_segment(0x00, dict(enumerate(DC_LENGTHS))), table_segment(0x10, {0: 1}),
        b"\xff\xdd\x00\x04", WIDTH.to_bytes(2, "big"), b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"))


@functools.cache
def _symbols():
    """By DC difference + 255: the left-aligned 16-bit code of a block (DC size, magnitude, end of block), and its length."""
    codes = canonical(dict(enumerate(DC_LENGTHS)))
    value, length = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        bits = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = n + size + 1
        value[d + 255] = bits << (15 - n - size)
    taken = np.arange(16) < np.arange(17)[:, None]
    return value, length, taken


def write_images(images: list[np.ndarray]) -> list[bytes]:
    """Baseline JPEGs of thumbnails, each (rows, ``WIDTH``) of uint8: one 8 x 8 block for each byte."""
    value, length, taken = _symbols()
    pixels = np.concatenate(images).astype(np.int16)
    change = np.diff(pixels - 128, axis=1, prepend=0) + 255
    bits = length[change]
    total = bits.sum(axis=1, dtype=np.int64)
    fill = (-total % 8).astype(np.uint8)[:, None]  # ones up to the byte's end
    words = np.concatenate([value[change], np.full((len(pixels), 1), 0xFFFF, np.uint16)], axis=1)
    spread = np.unpackbits(words.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    stream = np.packbits(spread[taken[np.concatenate([bits, fill], axis=1)].reshape(-1, 16)])
    ends = np.cumsum((total + 7) // 8)
    full = stream == 255
    at = np.arange(len(stream)) + np.cumsum(full) - full + 2 * np.repeat(np.arange(len(pixels)), np.diff(ends, prepend=0))
    out = np.zeros(len(stream) + int(full.sum()) + 2 * len(pixels), np.uint8)
    out[at] = stream
    marks = at[ends - 1] + 1 + full[ends - 1]
    sizes = np.array([len(x) for x in images])
    last = np.cumsum(sizes) - 1
    row = np.arange(len(pixels)) - np.repeat(last + 1 - sizes, sizes)
    out[marks] = 0xFF
    out[marks + 1] = 0xD0 + row % 8
    out[marks[last] + 1] = 0xD9
    cuts = [0, *(marks[last] + 2).tolist()]
    return [header(int(n)) + out[a:b].tobytes() for n, a, b in zip(sizes, cuts, cuts[1:])]


def parse(data: bytes, at: int = 0) -> tuple[dict, int, int]:
    """The marker segments of the image at ``at``, and where its scan starts and ends (before the end marker)."""
    if data[at:at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    found: dict = {"restart": 0}
    while True:
        while data[at:at + 2] == b"\xff\xff":
            at += 1
        if data[at:at + 1] != b"\xff" or at + 4 > len(data):
            raise ValueError("no marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2:at + 4], "big")
        body = data[at + 4:at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found["quantiser", body[0] & 15] = int.from_bytes(body[1:2 + wide], "big")
                body = body[1 + 64 * (1 + wide):]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols = iter(body[17:17 + sum(counts)])
                found["codes", body[0]] = tuple((next(symbols), n) for n, k in enumerate(counts, 1) for _ in range(k))
                body = body[17 + sum(counts):]
        elif marker == 0xC0:
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            found |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "parts": parts}
            if body[0] != 8 or not parts or not found["height"] or not found["width"] or not all(0 < h < 5 and 0 < v < 5 for _, h, v, _ in parts):
                raise ValueError("no 8-bit image of stated size")
            found["table"] = parts[0][3]
        elif 0xC0 < marker < 0xD0:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            found["restart"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            if "parts" not in found:
                raise ValueError("no frame before the scan")
            scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0])}
            start = at + 2 + size
            end = data.find(b"\xff\xd9", start)
            end = len(data) if end < 0 else end
            if body[0] < len(found["parts"]):
                # The components come in scans of their own; luminance is the first one's.
                if list(scan) != [found["parts"][0][0]]:
                    raise ValueError("luminance shares a scan with some components only")
                found["alone"], stop = True, data.find(b"\xff\xda", start)
                for kind in (b"\xff\xc4", b"\xff\xdb", b"\xff\xdd", b"\xff\xda"):
                    stop = min((x for x in (stop, data.find(kind, start, end)) if x >= 0), default=-1)
                found["stop"] = end if stop < 0 else stop
            elif set(scan) != {p[0] for p in found["parts"]}:
                raise ValueError("a scan of components without a frame")
            found["scan"] = scan
            found["dc"], found["ac"] = scan[found["parts"][0][0]]
            found["start"] = start
            return found, start, end
        at += 2 + size


def layout(spec: dict) -> tuple[int, int, int, int]:
    """Luminance blocks down and across, and the units of a scan (MCUs) down and across."""
    most_h, most_v = max(p[1] for p in spec["parts"]), max(p[2] for p in spec["parts"])
    _, h, v, _ = spec["parts"][0]
    down, across = -(-spec["height"] * v // (8 * most_v)), -(-spec["width"] * h // (8 * most_h))
    return down, across, -(-spec["height"] // (8 * most_v)), -(-spec["width"] // (8 * most_h))


def read_interleaved(spec: dict, scan: bytes) -> np.ndarray:
    """The luminance's DC coefficients, still quantised, of one scan of several components."""
    down, across, rows, columns = layout(spec)
    most = spec["parts"][0][1:3]
    out = np.zeros((rows * most[1], columns * most[0]), np.int64)
    plan = []
    for k, (name, h, v, _) in enumerate(spec["parts"]):
        dc, ac = spec["scan"][name]
        plan += [(k, y, x, _lookup(spec["codes", dc]).tolist(), _lookup(spec["codes", ac]).tolist()) for y in range(v) for x in range(h)]
    units = rows * columns
    step = spec["restart"] or units
    parts = re.split(rb"\xff[\xd0-\xd7]", scan)
    if len(parts) < -(-units // step):
        raise ValueError("wrong number of restart intervals")
    for begin, part in zip(range(0, units, step), parts):
        raw = part.replace(b"\xff\x00", b"\xff")
        data, pos, end = raw + b"\xff\xff\xff\xff", 0, 8 * len(raw)
        level = [0] * len(spec["parts"])
        for unit in range(begin, min(begin + step, units)):
            for k, y, x, dc, ac in plan:
                place = -1
                while place < 63:
                    at = pos >> 3
                    bits = int.from_bytes(data[at:at + 5], "big") >> (8 - (pos & 7)) & 0xFFFFFFFF
                    found = (dc if place < 0 else ac)[bits >> 16]
                    pos += found & 255
                    run, size = (0, found >> 8) if place < 0 else (found >> 12, found >> 8 & 15)
                    pos += size
                    if found < 0 or pos > end or size > 16:
                        raise ValueError("bad code, or the scan ends early")
                    if place < 0:
                        value = bits >> (32 - (found & 255) - size) & ((1 << size) - 1)
                        level[k] += value if not size or value >> (size - 1) else value - (1 << size) + 1
                    elif not size and run < 15:
                        break
                    place += run + 1
                if not k:
                    out[unit // columns * most[1] + y, unit % columns * most[0] + x] = level[0]
    return out[:down, :across].ravel()


@functools.lru_cache(maxsize=16)
def _lookup(codes: tuple) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | length of the code, or -1."""
    out = np.full(1 << 16, -1, np.int32)
    for symbol, (code, n) in canonical(dict(codes)).items():
        out[code << (16 - n):(code + 1) << (16 - n)] = symbol << 8 | n
    return out


def _magnitude(bits, size):
    """The signed number of ``size`` bits."""
    return np.where(bits >> np.maximum(size - 1, 0) & 1, bits, bits - (1 << size) + 1) * (size > 0)


@functools.lru_cache(maxsize=16)
def _blocks(dc: tuple, ac: tuple) -> np.ndarray:
    """By the next 16 bits: (difference + 32768) << 8 | bits, where a block without AC coefficients fits in them; else 0."""
    first, then = _lookup(dc), _lookup(ac)
    bits = np.arange(1 << 16)
    size, n = first >> 8, first & 255
    ok = (first >= 0) & (n + size < 16)
    size, n = np.where(ok, size, 0), np.where(ok, n, 0)
    diff = _magnitude(bits >> (16 - n - size) & ((1 << size) - 1), size)
    rest = then[bits << (n + size) & 0xFFFF]
    total = n + size + (rest & 255)
    return np.where(ok & (rest >= 0) & (rest >> 8 == 0) & (total <= 16), (diff + 32768) << 8 | total, 0)


def _window(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The 16 bits at each bit position."""
    at = pos >> 3
    three = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
    return three >> (8 - (pos & 7)) & 0xFFFF


def _long_blocks(data: np.ndarray, pos: np.ndarray, dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """DC differences and bit lengths of blocks with AC coefficients, all blocks in step."""
    found = _lookup(dc)[_window(data, pos)]
    if (found < 0).any():
        raise ValueError("bad DC code")
    size, start = found >> 8, pos
    pos = pos + (found & 255)
    diff = _magnitude(_window(data, pos) >> (16 - size), size)
    pos = pos + size
    place, live = np.ones(len(pos), np.int64), np.arange(len(pos))
    while len(live):
        found = _lookup(ac)[_window(data, pos[live])]
        if (found < 0).any():
            raise ValueError("bad AC code")
        run, size = found >> 12, found >> 8 & 15
        pos[live] += (found & 255) + size
        place[live] += run + 1
        live = live[((size > 0) | (run == 15)) & (place[live] < 64)]
    return diff, pos - start


def read_scans(scans: list[np.ndarray], blocks: int, dc: tuple, ac: tuple, restart: int) -> list[np.ndarray]:
    """The DC coefficients, still quantised, of each scan of ``blocks[i]`` blocks.

    Restart intervals of all scans are decoded in step, one block of each at a time.
    """
    raw = np.concatenate([x for s in scans for x in (s, np.array([0xFF, 0xD9], np.uint8))])
    full = np.flatnonzero(raw[:-1] == 255)
    mark = full[raw[full + 1] != 0]
    gone = np.zeros(len(raw), bool)
    gone[full + 1] = True
    gone[mark] = True
    data = np.concatenate([raw[~gone], np.full(4, 255, np.uint8)])
    begins = np.concatenate([[0], (mark + 2)[:-1]])
    pos = (begins - np.cumsum(np.concatenate([[0], gone]))[begins]) << 3
    each = np.concatenate([np.minimum(restart or n, n - np.arange(0, n, restart or n)) for n in blocks])
    if len(each) != len(pos) or not len(each):
        raise ValueError("wrong number of restart intervals")
    window = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    ends = (np.concatenate([begins[1:], [len(raw)]]) - np.cumsum(np.concatenate([[0], gone]))[np.concatenate([begins[1:], [len(raw)]])]) << 3
    table = _blocks(dc, ac)
    out = np.zeros((len(pos), int(each.max())), np.int32)
    level = np.zeros(len(pos), np.int32)
    order = np.argsort(-each, kind="stable")
    pos, active = pos[order], len(pos)
    for i in range(out.shape[1]):
        active = int(np.searchsorted(-each[order], -i, side="left"))
        p = pos[:active]
        got = table[(window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(16)]
        long = np.flatnonzero(got == 0)
        diff, bits = (got >> 8) - 32768, got & 255
        if len(long):
            diff[long], bits[long] = _long_blocks(data, p[long], dc, ac)
        level[:active] += diff.astype(np.int32)
        pos[:active] += bits
        out[order[:active], i] = level[:active]
    if (pos > ends[order]).any():
        raise ValueError("the scan ends early")
    flat = out[np.arange(out.shape[1]) < each[:, None]]
    return np.split(flat, np.cumsum(blocks)[:-1])


def read_images(files: list[bytes]) -> list[list[np.ndarray]]:
    """For each file of one or more images, their DC-only luminance thumbnails, a pixel for each block."""
    found = []
    for k, data in enumerate(files):
        at = 0
        while at < len(data) and (not at or data[at:at + 2] == b"\xff\xd8"):
            spec, start, end = parse(data, at)
            found.append((k, spec, np.frombuffer(data, np.uint8, end - start, start)))
            at = end + 2
    kinds: dict[tuple, list[int]] = {}
    levels = {}
    for i, (_, spec, scan) in enumerate(found):
        if spec["quantiser", spec["table"]] < 1:
            raise ValueError("no quantiser")
        if len(spec["parts"]) > 1 and "alone" not in spec:
            levels[i] = read_interleaved(spec, scan.tobytes())
            continue
        kinds.setdefault((spec["codes", spec["dc"]], spec["codes", spec["ac"]], spec["restart"]), []).append(i)
    for (dc, ac, restart), own in kinds.items():
        blocks = [layout(found[i][1])[0] * layout(found[i][1])[1] for i in own]
        scans = [found[i][2][: found[i][1]["stop"] - found[i][1]["start"]] if "alone" in found[i][1] else found[i][2] for i in own]
        levels |= zip(own, read_scans(scans, blocks, dc, ac, restart))
    out: list[list[np.ndarray]] = [[] for _ in files]
    for i, (k, spec, _) in enumerate(found):
        light = np.rint(levels[i] * spec["quantiser", spec["table"]] / 8 + 128)
        out[k].append(np.clip(light, 0, 255).astype(np.uint8).reshape(layout(spec)[:2]))
    return out


def read_images_safely(data: bytes | None) -> tuple[list[np.ndarray] | None, str | None]:
    """:func:`read_images` of one file, or None and the reason why it cannot be read."""
    try:
        if not data:
            raise ValueError("no data")
        return read_images([bytes(data)])[0], None
    except (ValueError, IndexError, KeyError, RuntimeError, MemoryError) as bad:
        return None, f"{type(bad).__name__}: {bad}"


def thumbnail_hash(image: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid of sums lie above their mean."""
    grid = np.add.reduceat(image, np.arange(8) * image.shape[0] // 8, axis=0, dtype=np.int64)
    grid = np.add.reduceat(grid, np.arange(8) * image.shape[1] // 8, axis=1)
    return np.packbits((8 * 8 * grid > grid.sum()).ravel()).tobytes().hex()


def store(texts: list[str | None]) -> tuple[list[int], list[bytes]]:
    """Each text's UTF-8 size, and its bytes, padded by spaces to a positive multiple of ``WIDTH``, as JPEG.

    A payload longer than ``MOST_ROWS`` rows becomes several images, one after another.
    """
    raw = [(t or "").encode("utf-8") for t in texts]
    images, owner = [], []
    for i, x in enumerate(raw):
        x += b" " * ((-len(x) % WIDTH) if x else WIDTH)
        rows = np.frombuffer(x, np.uint8).reshape(-1, WIDTH)
        for a in range(0, len(rows), MOST_ROWS):
            images.append(rows[a:a + MOST_ROWS])
            owner.append(i)
    files: list[list[bytes]] = [[] for _ in raw]
    held, size = [], 0
    for k, image in enumerate(images):
        held.append(k)
        size += len(image)
        if size >= 8192 or k == len(images) - 1:
            for j, data in zip(held, write_images([images[j] for j in held])):
                files[owner[j]].append(data)
            held, size = [], 0
    return [len(x) for x in raw], [b"".join(f) for f in files]


def features(media: bytes) -> dict:
    """What the stored bytes hold: payload, size in pixels and thumbnail hashes."""
    images = read_images([media])[0]
    return _describe(media, images)


def _describe(media: bytes, images: list[np.ndarray]) -> dict:
    payload = b"".join(x.tobytes() for x in images)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": ";".join(f"{8 * x.shape[1]}x{8 * x.shape[0]}:{thumbnail_hash(x)}" for x in images)}


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Add each text's bytes as a JPEG column, and ``n_bytes``; the texts are UTF-8, null as empty."""
    kept = [c for c in docs.columns if c not in (media_col, "n_bytes")]
    chosen = docs.select(*kept)
    at = kept.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, at):
            sizes, media = store(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*kept, "n_bytes", media_col])

    from pyspark.sql import types as T

    return map_arrow(chosen, run, T.StructType([*chosen.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())]))


def thumbnails(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Add what can be read from a column of JPEGs: ``thumb_width``, ``thumb_height``, ``thumb_hash``, ``media_error``.

    Baseline images of 8 bits are read, of one component or several (luminance is the first
    one's), in one scan or one each, with any sampling, tables and restart intervals.  A
    null, progressive, cut or otherwise bad file gives nulls and the reason, and no other row
    is touched.  The first image of a file with several counts.  Columns of these names are
    replaced; others pass through.  An empty table gives an empty result.
    """
    from pyspark.sql import types as T

    added = [("thumb_width", T.IntegerType()), ("thumb_height", T.IntegerType()), ("thumb_hash", T.StringType()), ("media_error", T.StringType())]
    kept = media.select(*[f"`{c}`" for c in media.columns if c not in dict(added)])
    names = kept.columns
    at = names.index(media_col)

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, at):
            rows = []
            for data in batch.column(at).to_pylist():
                images, bad = read_images_safely(data)
                rows.append((images[0].shape[1], images[0].shape[0], thumbnail_hash(images[0]), None) if images else (None, None, None, bad or "ValueError: no image"))
            more = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "thumb_width", "thumb_height", "thumb_hash", "media_error"])

    return map_arrow(kept, run, T.StructType([*kept.schema.fields, *(T.StructField(*x) for x in added)]))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as JPEG, read the stored bytes back, and describe them.

    A baseline JPEG keeps a byte exactly as the DC coefficient of a block of one value, so
    the payload is the DC-only thumbnail: one pixel a byte, 192 to a row, and every row a
    restart interval.  Reading parses the markers and decodes the scan by the file's own
    tables, with AC coefficients skipped; :func:`thumbnails` reads foreign files so.

    Returns ``id_col``, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``,
    ``media_bytes``, ``media_sha256``, ``feature`` (pixels and thumbnail hash of each image).
    A null or empty text is a row of 192 spaces.  Texts over 1.5 MB make several images.
    Equal texts have equal values; rows never meet.  Other columns are not read.  An empty
    table gives an empty result.
    """
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 1, 1 << 20):
            sizes, media = store(batch.column(1).to_pylist())
            rows = [_describe(m, x) for m, x in zip(media, read_images(media))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array([r[c] for r in rows], pa.string() if isinstance(rows[0][c], str) else pa.int64()) for c in rows[0])],
                ["id", "n_bytes", *rows[0]])

    return map_arrow(chosen, run, f"id {kind}, n_bytes long, {_FEATURES}").withColumnRenamed("id", id_col)
