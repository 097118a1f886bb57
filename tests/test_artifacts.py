"""Records of a classifier's files, by hand."""

import hashlib
import json

import pytest

from textloom import artifacts
from textloom.operators import metrics


@pytest.fixture
def made(tmp_path):
    for name in ("heads.pt", "split.json", "data.json", "train.py", "calibration.json", "card.json", "model/a.bin", "model/sub/b.bin", "model/heads.pt"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(name)
    files = artifacts.Files(tmp_path)
    paths = {"model": tmp_path / "model", "classification_heads": tmp_path / "heads.pt", "split_manifest": tmp_path / "split.json", "canonical_data_manifest": tmp_path / "data.json"}
    return tmp_path, files, paths, artifacts.new_record(files, paths, [tmp_path / "train.py"], without={"model": ["heads.pt"]}, head_type="h", label_mappings={"bias": {"a": 0}})


def test_tree_hash(made):
    root, *_ = made
    one = lambda n: hashlib.sha256(n.encode()).hexdigest()
    want = hashlib.sha256(f"a.bin\0{one('model/a.bin')}\nsub/b.bin\0{one('model/sub/b.bin')}\n".encode()).hexdigest()
    assert artifacts.sha256_tree(root / "model", ["heads.pt"]) == want
    with pytest.raises(FileNotFoundError):
        artifacts.sha256_tree(root / "none")


def test_life_of_a_record(made):
    root, files, paths, record = made
    assert artifacts.verify(record, files)["promotion_state"] == "pending_calibration"
    with pytest.raises(artifacts.Invalid):
        artifacts.bind_locked_test(record, files, root / "card.json", [])
    bound = artifacts.bind_calibration(record, files, root / "calibration.json")
    assert bound["artifact_manifest_sha256"] == record["artifact_manifest_sha256"] and bound["promotion_state"] == "pending_locked_test"
    done = artifacts.bind_locked_test(json.loads(json.dumps(bound)), files, root / "card.json", [])
    assert done["promotion_state"] == "eligible" and artifacts.bind_locked_test(bound, files, root / "card.json", ["x"])["promotion_state"] == "rejected"
    with pytest.raises(artifacts.Invalid):
        artifacts.bind_locked_test(done, files, root / "card.json", [])
    (root / "heads.pt").write_text("other")
    with pytest.raises(artifacts.Invalid, match="heads.pt has changed"):
        artifacts.verify(done, files)
    new = artifacts.refreshed(done, files)
    assert artifacts.verify(new, files)["calibration"] is None and new["artifact_manifest_sha256"] != record["artifact_manifest_sha256"]


@pytest.mark.parametrize("change", [{"schema_version": "x"}, {"core": {}}, {"artifact_manifest_sha256": "0"}, {"promotion_state": "eligible"}])
def test_tampered_records(made, change):
    with pytest.raises(artifacts.Invalid):
        artifacts.verify(made[3] | change)


def test_paths_stay_below_the_root(made, tmp_path_factory):
    root, files, *_ = made
    outside = tmp_path_factory.mktemp("out") / "x"
    outside.write_text("")
    with pytest.raises(artifacts.Invalid):
        files.entry(outside)
    with pytest.raises(artifacts.Invalid):
        files.hash_of({"path": "../x", "sha256": ""})


def test_agreement_with_a_calibration(made):
    root, files, paths, record = made
    same = dict(label_mappings={"bias": {"a": 0}}, head_type="h", head_types={"bias": "b"}, want_types={"bias": "b"}, split_manifest={"canonical_data_manifest_sha256": "d"}, data_manifest_sha256="d")
    assert artifacts.disagreements(record, files, paths, **same) == []
    other = artifacts.disagreements(record, files, paths | {"model": root / "heads.pt"}, **same | {"label_mappings": {"bias": {"a": 1}}, "head_type": "z", "head_types": {}, "data_manifest_sha256": "e"})
    assert other == ["path of model", "labels of bias", "head type", "head type of bias", "data manifest"]


def test_guard(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 1, 1.0)], "truth int, pred int, p double")
    assert metrics.guard(rows, [0, 1], pred="pred", score="p") is rows
    bad = spark.createDataFrame([(2, 1, 0.5), (None, 5, float("nan")), (1, 0, 1.5)], "truth int, pred int, p double")
    with pytest.raises(ValueError, match=r"truth not among \[0, 1\]: 2 rows; pred not among \[0, 1\]: 1 rows; p not between 0 and 1: 2 rows"):
        metrics.guard(bad, [0, 1], pred="pred", score="p")
    with pytest.raises(ValueError):
        metrics.guard(rows, [0, 0])
