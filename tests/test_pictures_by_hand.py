"""Corruptions and layers against plain loops and figures worked out by hand."""

import json
import math

import numpy as np
import pytest

from curata.functions import pixels
from curata.operators import pictures
from curata.sources import manifest


def picture(height=10, width=15, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def test_gamma_and_noise_by_their_formulas():
    x = picture()
    for name, power in (("gamma_low", 0.45), ("gamma_high", 2.0)):
        assert np.array_equal(pixels.corrupt(x, name, 0), [[[int((v / 255) ** power * 255) for v in p] for p in row] for row in x])
    noise = np.random.default_rng(7).normal(0, 0.08, x.shape).astype(np.float32)
    got = pixels.corrupt(x, "gaussian_noise", 7)
    for (i, j, k), v in np.ndenumerate(x):
        assert got[i, j, k] == int(min(max(np.float32(v) / np.float32(255) + noise[i, j, k], np.float32(0)), np.float32(1)) * np.float32(255))
    assert not np.array_equal(got, pixels.corrupt(x, "gaussian_noise", 8))


def test_contrast_letterbox_and_downscale_by_hand():
    x = np.array([[[200, 100, 0], [0, 100, 200]]], np.uint8)
    middle = round((0.299 * 200 + 0.587 * 100 + 0.587 * 100 + 0.114 * 200) / 2)
    faded = [[round(middle + (v - middle) * 0.45) for v in p] for p in x[0].tolist()]
    assert pixels.corrupt(x, "contrast_crush", 0)[0].tolist() == [[round(v * 1.25) for v in p] for p in faded]
    boxed = pixels.corrupt(picture(), "letterbox", 0)
    assert boxed.shape == (10, 15, 3) and (boxed[:2] == 118).all() and (boxed[8:] == 118).all() and (boxed[:, :3] == 118).all() and (boxed[:, 12:] == 118).all()
    assert np.array_equal(boxed[2:8, 3:12], pixels.to_bytes(pixels.resize(picture(), 6, 9)))
    flat = np.full((40, 60, 3), (10, 200, 90), np.uint8)
    assert np.array_equal(pixels.corrupt(flat, "downscale", 0), flat)
    with pytest.raises(ValueError):
        pixels.corrupt(flat, "sideways", 0)


def test_hue_turns_by_its_share_of_the_circle():
    turned = pixels.corrupt(np.array([[[255, 0, 0], [7, 7, 7]]], np.uint8), "hue_shift", 0)[0]
    assert turned[1].tolist() == [7, 7, 7]
    share = 38 * 6 / 255  # of the way from red to yellow
    assert turned[0].tolist() == [255, round(255 * share), 0] or abs(int(turned[0][1]) - 255 * share) <= 1


def test_resizing_by_loops():
    """Each new place is the mean of old ones, weighted by a triangle as wide as the step."""
    x = picture(7, 9, 3).astype(float)
    got = pixels.resize(x, 3, 4)
    for i in range(3):
        for j in range(4):
            rows = [max(0, 1 - abs(a + 0.5 - (i + 0.5) * 7 / 3) / (7 / 3)) for a in range(7)]
            columns = [max(0, 1 - abs(b + 0.5 - (j + 0.5) * 9 / 4) / (9 / 4)) for b in range(9)]
            want = sum(rows[a] * columns[b] * x[a, b] for a in range(7) for b in range(9)) / sum(rows) / sum(columns)
            assert np.allclose(got[i, j], want)


def test_a_block_of_the_network_by_loops():
    model = pictures.Cnn((2,), 3, seed=4)
    draw = np.random.default_rng(1)
    model.blocks = [[(w, *(draw.uniform(0.5, 1.5, len(g)) for _ in range(4))) for w, g, *_ in block] for block in model.blocks]
    model.bias = draw.normal(0, 1, 3)
    x = draw.normal(0, 1, (3, 5, 4))

    def layer(x, weight, gamma, beta, mean, variance):
        out = np.zeros((len(weight), *x.shape[1:]))
        for o in range(len(weight)):
            for i in range(x.shape[1]):
                for j in range(x.shape[2]):
                    total = 0.0
                    for c in range(len(x)):
                        for a in (-1, 0, 1):
                            for b in (-1, 0, 1):
                                if 0 <= i + a < x.shape[1] and 0 <= j + b < x.shape[2]:
                                    total += weight[o, c, a + 1, b + 1] * x[c, i + a, j + b]
                    out[o, i, j] = max(0.0, (total - mean[o]) / math.sqrt(variance[o] + 1e-5) * gamma[o] + beta[o])
        return out

    y = layer(layer(x, *model.blocks[0][0]), *model.blocks[0][1])
    pooled = np.array([[[y[c, 2 * i : 2 * i + 2, 2 * j : 2 * j + 2].max() for j in range(2)] for i in range(2)] for c in range(2)])
    want = [sum(model.weights[k, c] * pooled[c].mean() for c in range(2)) + model.bias[k] for k in range(3)]
    assert np.allclose(model.forward(x), want)


def test_runs_are_read_with_their_best_epoch(spark, tmp_path):
    for run, best in (("a", 2), ("b", 1)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "history.json").write_text(json.dumps({"epochs": [{"epoch": e, "loss": e / 10, "run_name": run} for e in (1, 2, 3)]}, indent=2))
        (tmp_path / run / "run_metadata.json").write_text(json.dumps({"best_epoch": best, "seed": 4, "loss": 9}, indent=2))
    (tmp_path / "c").mkdir()  # a run that did not end
    (tmp_path / "c" / "history.json").write_text(json.dumps({"epochs": [{"epoch": 1, "loss": 0.1, "run_name": "c"}]}))
    got = {r.run: r for r in manifest.read_runs(spark, str(tmp_path)).collect()}
    assert {k: (r.epoch, r.loss, r.seed) for k, r in got.items()} == {"a": (2, 0.2, 4), "b": (1, 0.1, 4)}
