import numpy as np
import pytest

from curata.operators import evaluation, network, picture_network, pictures
from curata.sources import prepare

SETTINGS = network.Settings(epochs=3, batch=8, batches_a_step=1, rate=1e-2, dropout=0.1, patience=3)


def test_gradients_against_differences():
    draw = np.random.default_rng(2)
    model = pictures.Cnn((3, 4), 3, seed=1)
    model.blocks = [[(w, draw.uniform(0.5, 1.5, len(g)), draw.normal(0, 0.3, len(g)), m, v) for w, g, _, m, v in block] for block in model.blocks]
    x, y = draw.normal(0, 1, (3, 3, 7, 6)), np.array([2, 0, 1])
    keep = (draw.random((3, 4)) >= 0.2) / 0.8
    values = picture_network.flat(model)
    loss, grad, seen = picture_network.gradients(model, x, y, keep)
    assert grad.shape == values.shape and len(seen) == 2 * (3 + 3 + 4 + 4) and loss > 0
    for k in range(0, len(values), 3):
        sides = []
        for step in (1e-6, -1e-6):
            moved = values.copy()
            moved[k] += step
            picture_network.filled(model, moved)
            sides.append(picture_network.gradients(model, x, y, keep)[0])
        assert abs((sides[0] - sides[1]) / 2e-6 - grad[k]) < 1e-4 * max(1, abs(grad[k])), k


def test_the_trained_network_is_the_one_that_predicts():
    """With a batch's own statistics stored, forward() gives what training saw."""
    draw = np.random.default_rng(3)
    model, x = pictures.Cnn((2, 3), 4, seed=2), draw.normal(0, 1, (5, 3, 8, 8))
    loss, _, seen = picture_network.gradients(model, x, np.arange(5) % 4, np.ones((5, 3)), smoothing=0.0)
    at, blocks = 0, []
    for block in model.blocks:
        layers = []
        for w, g, b, m, _ in block:
            n = len(m)
            unbiased = 5 * 64 // 4 ** len(blocks)
            layers.append((w, g, b, seen[at : at + n], seen[at + n : at + 2 * n] * (unbiased - 1) / unbiased))
            at += 2 * n
        blocks.append(layers)
    model.blocks = blocks
    logs = [z - np.log(np.exp(z).sum()) for z in map(model.forward, x)]
    assert loss == pytest.approx(-sum(p[k % 4] for k, p in enumerate(logs)))


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pictures")
    evaluation.put_files(prepare.fixture(spark, ["A", "B", "C"], 10, 48, 4), str(folder))
    return pictures.read(spark, str(folder)).selectExpr("regexp_extract(path, '([^/]+/[^/]+)$', 1) AS path", "height", "width", "channels", "data").selectExpr("*", "left(path, 1) AS label")


def test_pictures_are_learned_whatever_their_partitions(rows):
    train, held = rows.where("right(path, 5) < '7.png'"), rows.where("right(path, 5) >= '7.png'")
    settings = network.Settings(epochs=14, batch=7, batches_a_step=1, rate=2e-2, dropout=0.0, patience=14)
    fitted = picture_network.fit(train, held, "label", 12, (4, 6), "baseline", settings)
    assert fitted.classes == ["A", "B", "C"] and max(h["accuracy"] for h in fitted.history) > 0.8
    best = fitted.history[fitted.best_epoch - 1]
    scored = picture_network.predict(held, fitted, 12)
    assert scored.where("prediction = label").count() / scored.count() == pytest.approx(best["accuracy"])
    again = picture_network.fit(train.repartition(5), held.repartition(2), "label", 12, (4, 6), "robust_noflip", network.Settings(epochs=1, batch=7, batches_a_step=1, rate=2e-2, dropout=0.0, patience=8))
    other = picture_network.fit(train.repartition(2), held, "label", 12, (4, 6), "robust_noflip", network.Settings(epochs=1, batch=7, batches_a_step=1, rate=2e-2, dropout=0.0, patience=8))
    assert np.abs(picture_network.flat(again.model) - picture_network.flat(other.model)).max() < 1e-9


def test_what_no_run_takes(rows):
    for bad in (lambda: picture_network.fit(rows, rows, "label", 3, (4, 6)), lambda: picture_network.fit(rows.where("label = 'A'"), rows, "label", 12, (4,)), lambda: picture_network.fit(rows, rows.limit(0), "label", 12, (4,)), lambda: picture_network.fit(rows, rows, "label", 12, (4,), "none")):
        with pytest.raises(ValueError):
            bad()
