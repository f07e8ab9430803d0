import io
import math
import struct

import numpy as np
import pytest

from curata.functions import augment, jpeg, pixels
from curata.operators import pictures


def picture(height=24, width=32, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def soft(height=64, width=48):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 11), (x + y) * 2 % 256], -1).clip(0, 255).astype(np.uint8)


def test_profiles_are_named_and_others_refused():
    assert set(augment.PROFILES) == {"baseline", "robust", "robust_noflip", "trivialaugment"} and augment.DEFAULT in augment.PROFILES
    with pytest.raises(ValueError, match="sideways"):
        augment.profile("sideways")
    assert not any(kind == "flip" for kind, *_ in augment.PROFILES["robust_noflip"])


def test_a_warp_without_movement_changes_nothing():
    x = picture()
    assert np.array_equal(augment.warped(x, augment.inverse_affine(0, 0, 0, 1, 0, 0)), x)
    assert np.array_equal(augment.applied(x, [("affine", 0, 0, 0, 1, 0, 0), ("brightness", 1), ("contrast", 1), ("saturation", 1), ("sharpness", 1), ("posterise", 8)]), x)


def test_warps_against_loops():
    """Each pixel by hand: where it comes from, and the four around that place."""
    x = picture(9, 12, 1).astype(float)
    for said in [(17, 2, -1, 1.2, 5, 0), (-90, 0, 0, 1, 0, 0), (0, 3, 1, 1, 0, 0), (33, 0.5, 0.25, 0.7, -10, 8)]:
        back, got = augment.inverse_affine(*said), augment.warped(x, augment.inverse_affine(*said))
        for i in range(9):
            for j in range(12):
                u, v = back @ [j - 5.5, i - 4, 1]
                u, v = u + 5.5, v + 4
                want = np.zeros(3)
                for r in range(9):
                    for c in range(12):
                        want += max(0, 1 - abs(r - v)) * max(0, 1 - abs(c - u)) * x[r, c]
                assert np.allclose(got[i, j], want, atol=1e-6), said


def test_turns_and_shifts_of_whole_pixels():
    x = picture(7, 7, 2)
    assert np.array_equal(augment.applied(x, [("affine", 90, 0, 0, 1, 0, 0)]), np.rot90(x, 3))  # clockwise
    moved = augment.applied(x, [("affine", 0, 2, 1, 1, 0, 0)])
    assert np.array_equal(moved[1:, 2:], x[:-1, :-2]) and not moved[0].any() and not moved[:, :2].any()
    wide = augment.warped(x, augment.inverse_affine(0, 0, 0, 2, 0, 0))
    assert np.allclose(wide[3, 3], x[3, 3]) and np.allclose(wide[3, 5], x[3, 4])


def test_colours_by_hand():
    x = np.array([[[100, 50, 200], [0, 255, 10]]], np.uint8)
    grey = np.rint([0.299 * 100 + 0.587 * 50 + 0.114 * 200, 0.587 * 255 + 1.14])
    assert np.array_equal(augment.applied(x, [("brightness", 1.2)])[0], [[120, 60, 240], [0, 255, 12]])
    assert np.array_equal(augment.applied(x, [("saturation", 0)])[0], np.repeat(grey[:, None], 3, 1))
    assert np.array_equal(augment.applied(x, [("grey",)])[0], np.repeat(grey[:, None], 3, 1))
    mean = np.rint((0.299 * 100 + 0.587 * 50 + 0.114 * 200 + 0.587 * 255 + 1.14) / 2)
    assert np.array_equal(augment.applied(x, [("contrast", 0.5)])[0, 0], np.rint(mean + ([100, 50, 200] - mean) * 0.5))
    assert np.array_equal(augment.applied(x, [("solarise", 200)])[0], [[100, 50, 55], [0, 0, 10]])
    assert np.array_equal(augment.applied(x, [("posterise", 1)])[0], [[0, 0, 128], [0, 128, 0]])
    assert np.array_equal(augment.applied(x, [("stretch",)])[0], [[255, 0, 255], [0, 255, 0]])
    assert np.array_equal(augment.applied(x, [("flip",)])[0], x[0, ::-1])
    ramp = np.arange(256, dtype=np.uint8).reshape(16, 16, 1).repeat(3, 2)
    assert np.abs(augment.applied(ramp, [("equalise",)]).astype(int) - ramp).max() <= 1
    spike = np.zeros((3, 3, 3), np.uint8)
    spike[1, 1] = 130
    assert augment._smoothed(spike)[1, 1, 0] == 50 and augment.applied(spike, [("sharpness", 2)])[1, 1, 0] == 210
    red = np.full((1, 1, 3), (255, 0, 0), np.uint8)
    assert augment.applied(red, [("hue", 1 / 3)])[0, 0].tolist() == [0, 255, 0]
    with pytest.raises(ValueError, match="upside"):
        augment.applied(x, [("upside",)])


def test_what_is_drawn_stays_in_range():
    shares, flips, erased = [], 0, 0
    for k in range(400):
        for name in augment.PROFILES:
            changes = augment.drawn(name, augment.generator(1, 2, k), 40, 60, 32)
            (_, top, left, h, w, size), *rest = changes
            assert size == 32 and 0 <= top <= 40 - h and 0 <= left <= 60 - w
            kinds = [c[0] for c in rest]
            if name == "baseline":
                shares.append(h * w / 2400)
                flips += "flip" in kinds
                angle = next(c for c in rest if c[0] == "affine")
                assert abs(angle[1]) <= 10 and angle[2:] == (0, 0, 1, 0, 0) and "hue" not in kinds
            if name == "robust":
                assert all(abs(c[1]) <= 0.08 for c in rest if c[0] == "hue")
            for c in rest:
                if c[0] == "erase":
                    erased += 1
                    assert 0.01 < c[3] * c[4] / 1024 < 0.17
    # Where no area of the asked ratio fits, the middle serves: 40 x 44 here.
    assert 40 * 44 / 2400 <= min(shares) and max(shares) <= 1.02 and 150 < flips < 250 and 200 < erased < 400


def test_training_input_depends_on_key_and_epoch_alone(spark):
    rows = [(f"p{k}", *(s := picture(20 + k, 30, k)).shape[:2], 3, s[..., ::-1].tobytes(), f"own{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary, note string")
    for name in augment.PROFILES:
        a = {r.path: r for r in pictures.augmented(df, name, 3, 16).collect()}
        b = {r.path: r for r in pictures.augmented(df.repartition(5), name, 3, 16).collect()}
        assert {p: r.tensor for p, r in a.items()} == {p: r.tensor for p, r in b.items()} and all(r.note == "own" + p[1:] for p, r in a.items())
        other = {r.path: r.tensor for r in pictures.augmented(df, name, 4, 16).collect()}
        assert all(len(r.tensor) == 3 * 16 * 16 for r in a.values()) and sum(other[p] != r.tensor for p, r in a.items()) >= 5
        draw = augment.generator(42, 3, "p1")
        want = augment.normalised(picture(21, 30, 1), 16, augment.drawn(name, draw, 21, 30, 16))
        assert np.allclose(a["p1"].tensor, want.ravel())
    assert pictures.augmented(df.limit(0), "robust", 1, 8).collect() == []
    with pytest.raises(ValueError):
        pictures.augmented(df, "none", 1, 8)
    plain = augment.normalised(rows_first := picture(20, 30, 0), 16)
    assert np.allclose(plain, pixels.preprocess(rows_first, 16), atol=0.02)


def test_cosines_and_steps():
    assert np.allclose(jpeg.COSINES @ jpeg.COSINES.T, np.eye(8))
    assert jpeg.steps(jpeg.BRIGHTNESS, 25)[0, :3].tolist() == [32, 22, 20] and jpeg.steps(jpeg.COLOUR, 25)[7, 7] == 198
    assert jpeg.steps(jpeg.BRIGHTNESS, 50)[3, 3] == 29 and jpeg.steps(jpeg.BRIGHTNESS, 100).max() == 1 and jpeg.steps(jpeg.COLOUR, 1).max() == 255
    for bad in (0, 101):
        with pytest.raises(ValueError):
            jpeg.steps(jpeg.COLOUR, bad)


def test_one_block_by_hand():
    """Brightness 10 a row: a block whose transform has one column, each coefficient by its definition."""
    grey = np.repeat((10 * np.arange(16))[:, None], 16, 1)
    got = jpeg.recompressed(np.repeat(grey[..., None], 3, 2).astype(np.uint8), 25)
    own, table = 10.0 * np.arange(8) - 128, jpeg.steps(jpeg.BRIGHTNESS, 25)
    level = [round(sum(own[i] * math.cos((2 * i + 1) * u * math.pi / 16) for i in range(8)) * (math.sqrt(1 / 8) if u == 0 else 0.5) * math.sqrt(8) / table[u, 0]) * table[u, 0] for u in range(8)]
    want = [round(128 + sum(level[u] / math.sqrt(8) * (math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * i + 1) * u * math.pi / 16) for u in range(8))) for i in range(8)]
    assert np.abs(got[:8, :, 0].astype(int) - np.array(want)[:, None]).max() <= 1 and np.ptp(got[:8], axis=1).max() == 0


def by_the_jvm(spark, image, quality):
    """The picture through the JVM's own encoder and decoder; its quality 0.25 scales the same tables by the same 2."""
    jvm = spark.sparkContext._jvm
    height, width = image.shape[:2]
    out = jvm.java.awt.image.BufferedImage(width, height, 1)
    rgb = (image.astype(int) @ [65536, 256, 1]).ravel().tolist()
    values = spark.sparkContext._gateway.new_array(jvm.int, len(rgb))
    for k, v in enumerate(rgb):
        values[k] = v
    out.setRGB(0, 0, width, height, values, 0, width)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    raw = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(raw))
    writer.write(None, jvm.javax.imageio.IIOImage(out, None, None), param)
    writer.dispose()
    return bytes(raw.toByteArray())


def decoded(spark, content, tmp_path, name="x.jpg"):
    (tmp_path / name).write_bytes(content)
    r = pictures.read(spark, str(tmp_path)).where(f"path LIKE '%{name}'").first()
    return pictures.array_of(r.data, r.height, r.width, r.channels)


def test_recompression_equals_a_real_codec(spark, tmp_path):
    for k, x in enumerate([soft(), soft(35, 51), picture(16, 16, 5)]):
        real = decoded(spark, by_the_jvm(spark, x, 0.25), tmp_path, f"q{k}.jpg").astype(int)
        own = pixels.corrupt(x, "jpeg_q25", 0).astype(int)
        assert own.shape == x.shape and np.abs(own - real).mean() < 0.8, k
        assert np.abs(own - x).mean() > 2 * np.abs(own - real).mean()


def exif(order, value, tag=0x0112, kind=3):
    entry = struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    other = struct.pack(order + "HHI", 0x010F, 2, 4) + b"abc\0"
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, 2) + other + entry + struct.pack(order + "I", 0)
    return b"Exif\0\0" + tiff


def with_segment(jpeg_bytes, body, marker=0xE1):
    return jpeg_bytes[:2] + bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body + jpeg_bytes[2:]


def test_all_eight_turns_in_both_orders():
    x = np.arange(6).reshape(2, 3)
    plain = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda"
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    for value, turned in want.items():
        for order in "<>":
            for kind in (3, 4):
                assert jpeg.orientation(with_segment(plain, exif(order, value, kind=kind))) == value
                assert jpeg.orientation(with_segment(with_segment(plain, exif(order, value, kind=kind)), b"more", 0xE0)) == value
        assert jpeg.turned(x, value).tolist() == turned


def test_damaged_and_missing_tags_leave_pictures_as_they_are():
    plain = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda"
    whole = with_segment(plain, exif("<", 6))
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 2) + b"tEXtab" + b"\0" * 4
    body = exif(">", 8)[6:]
    assert jpeg.orientation(png + struct.pack(">I", len(body)) + b"eXIf" + body + b"\0" * 4) == 8
    for content in [None, b"", b"\xff", b"\xff\xd8", plain, whole[:20], whole[:30], with_segment(plain, exif("<", 0)), with_segment(plain, exif("<", 9)), with_segment(plain, exif("<", 6, tag=0x0111)), with_segment(plain, exif("<", 6, kind=5)), with_segment(plain, b"Exif\0\0XX" + b"\0" * 20), png, b"GIF89a", io.BytesIO(b"text").read()]:
        assert jpeg.orientation(content) == 1, content
    assert jpeg.orientation(whole) == 6


def test_photographs_are_read_upright(spark, tmp_path):
    content = by_the_jvm(spark, soft(32, 48), 0.9)
    for value in (1, 3, 6):
        (tmp_path / f"t{value}.jpg").write_bytes(with_segment(content, exif("<", value)))
    (tmp_path / "plain.png").write_bytes(pixels.png(soft(8, 4)))
    (tmp_path / "broken.jpg").write_bytes(content[:40])
    rows = {r.path.rsplit("/", 1)[1]: r for r in pictures.read_upright(spark, str(tmp_path)).collect()}
    assert set(rows) == {"t1.jpg", "t3.jpg", "t6.jpg", "plain.png"}
    upright = pictures.array_of(rows["t1.jpg"].data, 32, 48, 3)
    assert (rows["t6.jpg"].height, rows["t6.jpg"].width) == (48, 32)
    assert np.array_equal(pictures.array_of(rows["t6.jpg"].data, 48, 32, 3), np.rot90(upright, 3))
    assert np.array_equal(pictures.array_of(rows["t3.jpg"].data, 32, 48, 3), upright[::-1, ::-1])
