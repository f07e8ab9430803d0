import json

import pytest

from curata import __main__ as cli
from curata.operators import evaluation
from curata.sources import prepare

CLASSES = ["--classes", "A", "B", "C"]


def run(capsys, *said):
    code = cli.main(list(map(str, said)))
    out = capsys.readouterr()
    return code, json.loads(out.out) if code == 0 else out.err


def test_from_a_folder_to_predictions(spark, tmp_path, capsys):
    evaluation.put_files(prepare.fixture(spark, ["A", "B", "C"], 10, 64, 6), str(tmp_path / "in"))
    source, manifests, net = tmp_path / "in", tmp_path / "manifests", tmp_path / "net" / "compact"
    code, said = run(capsys, "prepare", "--source", source, "--out", manifests, "--ratios", 0.6, 0.2, 0.2, "--threshold", 0, *CLASSES)
    assert code == 0 and said["counts"]["per_split"] == {"train": 18, "validation": 6, "test": 6}
    code, said = run(capsys, "train", "--manifests", manifests, "--source", source, "--out", net, "--size", 12, "--epochs", 8, "--batch", 6, "--rate", 0.02, "--patience", 8, "--dropout", 0, "--channels", 4, 6, *CLASSES)
    assert code == 0 and len(said["history"]) <= 8 and said["best_epoch"] >= 1
    code, said = run(capsys, "evaluate", "--network", net, "--manifest", manifests / "test.csv", "--source", source, "--scope", "generated", "--out", tmp_path / "judged.json")
    assert code == 0 and said["n_rows"] == 6 and said["network"]["path"] == str(net) and sum(map(sum, said["confusion_matrix"])) == 6
    code, said = run(capsys, "predict", "--network", net, "--images", source / "A", "--top", 2, "--threshold", 1)
    assert code == 0 and len(said["pictures"]) == 10
    for p in said["pictures"]:
        assert len(p["predictions"]) == 2 and p["predictions"][0]["probability"] >= p["predictions"][1]["probability"] and p["warning"].startswith("Low confidence")
    code, said = run(capsys, "prepare-external", "--source", source, "--out", tmp_path / "external.csv", *CLASSES)
    assert code == 0 and said["rows"] == 30
    code, said = run(capsys, "split-external", "--manifest", tmp_path / "external.csv", "--out", tmp_path / "halves")
    assert code == 0 and said["dev"]["count"] == said["final"]["count"] == 15


def test_what_a_user_can_mend_gives_one_line_and_code_2(spark, tmp_path, capsys):
    (tmp_path / "empty").mkdir()
    for said in (
        ["prepare", "--source", tmp_path / "none", "--out", tmp_path / "o"],
        ["prepare", "--source", tmp_path / "empty", "--out", tmp_path / "o", "--ratios", 1, 2],
        ["train", "--manifests", tmp_path / "none", "--source", tmp_path, "--out", tmp_path / "o"],
        ["train", "--manifests", tmp_path, "--source", tmp_path, "--out", tmp_path / "o", "--profile", "sideways"],
        ["evaluate", "--network", tmp_path / "none", "--manifest", "x", "--source", "y", "--scope", "z"],
        ["predict", "--network", tmp_path / "none", "--images", tmp_path, "--threshold", 2],
    ):
        code, err = run(capsys, *said)
        assert code == 2 and err.startswith(f"curata {said[0]}: "), said
    with pytest.raises(SystemExit) as ended:
        cli.main(["fly"])
    assert ended.value.code == 2
    code, said = run(capsys, "doctor")
    assert code == 0 and said["spark"] == spark.version and said["java"]
