"""What a picture looks like after it was stored as JPEG, and the turns that photographs ask for."""

from __future__ import annotations

import struct

import numpy as np

#: The standard's example tables for brightness and colour at quality 50, row by row.
BRIGHTNESS = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
])
COLOUR = np.full((8, 8), 99)
COLOUR[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]

_places = np.arange(8)
#: The cosine transform of 8 values as a matrix; its transpose is the inverse.
COSINES = np.where(_places[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _places + 1) * _places[:, None] * np.pi / 16)


def steps(table: np.ndarray, quality: int) -> np.ndarray:
    """A table scaled to a quality from 1 to 100, by the usual rule."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must be 1 to 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * scale + 50) // 100, 1, 255)


def _padded(plane: np.ndarray, multiple: int) -> np.ndarray:
    h, w = plane.shape
    return np.pad(plane, ((0, -h % multiple), (0, -w % multiple)), mode="edge")


def _stored(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane after its 8 x 8 blocks were transformed, rounded to steps of the table and turned back."""
    h, w = plane.shape
    blocks = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - 128.0
    # Halves must not fall to either side by the order in which a machine adds.
    found = np.round(COSINES @ blocks @ COSINES.T / table, 9)
    kept = np.sign(found) * np.floor(np.abs(found) + 0.5) * table
    back = np.rint(COSINES.T @ kept @ COSINES + 128).clip(0, 255)
    return back.transpose(0, 2, 1, 3).reshape(h, w)


def _doubled(plane: np.ndarray) -> np.ndarray:
    """Twice as high and wide; a new place takes three parts of the nearest old one and one of the next."""
    for axis in (0, 1):
        ends = [(1, 1) if k == axis else (0, 0) for k in (0, 1)]
        p = np.moveaxis(np.pad(plane, ends, mode="edge"), axis, 0)
        both = np.stack([3 * p[1:-1] + p[:-2], 3 * p[1:-1] + p[2:]], 1) / 4
        plane = np.moveaxis(both.reshape(-1, *p.shape[1:]), 0, axis)
    return plane


def recompressed(image: np.ndarray, quality: int = 25) -> np.ndarray:
    """The RGB picture (bytes) as it comes back from JPEG of that quality with colour at half the resolution.

    Every loss of the format is there; a decoder's own rounding may differ by a few units a pixel.
    """
    height, width = image.shape[:2]
    r, g, b = (image[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [np.rint(p).clip(0, 255) for p in (y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402)]
    y, cb, cr = (_padded(p, 16) for p in planes)
    halved = [p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).sum((1, 3)) for p in (cb, cr)]
    # Sums of four are rounded up and down in turn, so that colours don't drift.
    halved = [np.floor((s + 1 + np.arange(s.shape[1]) % 2) / 4) for s in halved]
    y = _stored(y, steps(BRIGHTNESS, quality))[:height, :width]
    small = [_stored(p, steps(COLOUR, quality))[: -(-height // 2), : -(-width // 2)] for p in halved]
    cb, cr = (np.floor(_doubled(p) + 0.5)[:height, :width] - 128 for p in small)
    back = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.rint(back).clip(0, 255).astype(np.uint8)


#: Fixed value: the tag of a picture's orientation.
ORIENTATION = 0x0112


def _from_tiff(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or struct.unpack(order + "H", tiff[2:4])[0] != 42:
        return 1
    (at,) = struct.unpack(order + "I", tiff[4:8])
    (n,) = struct.unpack(order + "H", tiff[at : at + 2])
    for k in range(n):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if tag == ORIENTATION:
            if count != 1 or kind not in (3, 4):
                return 1
            return struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return 1


def orientation(content: bytes | None) -> int:
    """1 to 8: how a JPEG or PNG file asks to be turned; 1, as it is, where it does not say, or says so damaged."""
    found = 1
    try:
        if content and content[:2] == b"\xff\xd8":
            at = 2
            while content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
                if content[at + 1] == 0xFF:  # a fill byte
                    at += 1
                    continue
                (length,) = struct.unpack(">H", content[at + 2 : at + 4])
                if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                    found = _from_tiff(content[at + 10 : at + 2 + length])
                    break
                at += 2 + length
        elif content and content[:8] == b"\x89PNG\r\n\x1a\n":
            at = 8
            while content[at + 4 : at + 8] not in (b"IEND", b""):
                (length,) = struct.unpack(">I", content[at : at + 4])
                if content[at + 4 : at + 8] == b"eXIf":
                    found = _from_tiff(content[at + 8 : at + 8 + length])
                    break
                at += 12 + length
    except (struct.error, IndexError):
        return 1
    return found if 1 <= found <= 8 else 1


def turned(image: np.ndarray, how: int) -> np.ndarray:
    """The picture upright, from how its file asks to be turned: mirrored where it says so, then turned."""
    if how in (2, 4, 5, 7):
        image = image[:, ::-1]
    return np.rot90(image, {1: 0, 2: 0, 3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}[how])
