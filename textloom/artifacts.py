"""The record of a classifier's files: an identity that calibration can bind, and the states that it goes through. Driver-side; a few files."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from .sources.writers import canonical_json

# --- Fixed values ---
SCHEMA, FROZEN_SCHEMA = "artifact_manifest/v1", "frozen_artifact/v1"
PENDING_CALIBRATION, PENDING_TEST, ELIGIBLE, REJECTED = "pending_calibration", "pending_locked_test", "eligible", "rejected"
FILES = ["model", "classification_heads", "split_manifest", "canonical_data_manifest"]


class Invalid(ValueError):
    """The record, or a file that it names, isn't what it says."""


def sha256_json(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sha256_file(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def sha256_tree(path: Path, without: Iterable[str] = ()) -> str:
    """Of a file its bytes; of a folder the names and hashes of its files by name, some left out."""
    if path.is_file():
        return sha256_file(path)
    if not path.is_dir():
        raise FileNotFoundError(path)
    names = sorted(f.relative_to(path).as_posix() for f in path.rglob("*") if f.is_file())
    lines = (f"{n}\0{sha256_file(path / n)}\n" for n in names if n not in set(without))
    return hashlib.sha256("".join(lines).encode()).hexdigest()


@dataclass(frozen=True)
class Files:
    """Entries of files below one root."""

    root: Path

    def entry(self, path: str | Path, without: Iterable[str] = ()) -> dict:
        full, root = Path(path).resolve(), self.root.resolve()
        if root not in full.parents:
            raise Invalid(f"{full} is not below {root}")
        left = sorted(without)
        return {"path": full.relative_to(root).as_posix(), "kind": "directory" if full.is_dir() else "file", "sha256": sha256_tree(full, left)} | ({"excluded_relative_paths": left} if left else {})

    def hash_of(self, entry: dict) -> str:
        full, root = (self.root / entry["path"]).resolve(), self.root.resolve()
        if root not in full.parents:
            raise Invalid(f"{entry['path']} leaves {root}")
        if not full.exists():
            raise Invalid(f"{entry['path']} is missing")
        return sha256_tree(full, entry.get("excluded_relative_paths", ()))


def entries(record: dict) -> Iterator[dict]:
    """All entries of a record: its core's, those of its code, and what was bound to it."""
    for name, value in record["core"].get("files", {}).items():
        yield from value if name == "code" else [value]
    yield from (record[k] for k in ("calibration", "locked_test_evaluation") if record.get(k))


def sealed(record: dict) -> dict:
    """The record with the hash of all the rest of it."""
    rest = {k: v for k, v in record.items() if k != "document_sha256"}
    return rest | {"document_sha256": sha256_json(rest)}


def new_record(files: Files, paths: dict[str, str | Path], code: Iterable[str | Path], *, without: dict[str, list[str]] | None = None, **facts) -> dict:
    """A record that waits for calibration. ``paths``: the entries in FILES, and an evaluation_scorecard where there is one; ``facts``: head_type, label_mappings and what else belongs to the identity."""
    held = {k: files.entry(p, (without or {}).get(k, ())) for k, p in paths.items()}
    held["code"] = [files.entry(p) for p in sorted({str(Path(c).resolve()) for c in code})]
    core = {"files": held} | facts
    return sealed({"schema_version": SCHEMA, "artifact_manifest_sha256": sha256_json(core), "core": core, "calibration": None, "release_gate_results": None, "promotion_state": PENDING_CALIBRATION})


def verify(record: dict, files: Files | None = None) -> dict:
    """The record, if its hashes hold; with ``files`` also those of all its entries."""
    if record.get("schema_version") != SCHEMA:
        raise Invalid("schema version")
    if not record.get("core") or record.get("artifact_manifest_sha256") != sha256_json(record["core"]):
        raise Invalid("identity")
    if "document_sha256" in record and record != sealed(record):
        raise Invalid("document hash")
    for entry in entries(record) if files else ():
        if files.hash_of(entry) != entry["sha256"]:
            raise Invalid(f"{entry['path']} has changed")
    return record


def bind_calibration(record: dict, files: Files, calibration: str | Path, *, now: datetime.datetime | None = None) -> dict:
    """The record with its calibration, frozen: the identity stays, and it waits for the locked test."""
    entry = files.entry(calibration)
    core = {"schema_version": FROZEN_SCHEMA, "artifact_manifest_sha256": verify(record)["artifact_manifest_sha256"], "calibration_path": entry["path"], "calibration_sha256": entry["sha256"]}
    at = (now or datetime.datetime.now(datetime.UTC)).isoformat().replace("+00:00", "Z")
    frozen = core | {"frozen_artifact_sha256": sha256_json(core), "frozen_at_utc": at}
    return sealed(record | {"calibration": entry, "frozen_artifact": frozen, "locked_test_evaluation": None, "release_gate_results": None, "promotion_state": PENDING_TEST})


def bind_locked_test(record: dict, files: Files, scorecard: str | Path, failures: list[str]) -> dict:
    """The frozen record with its one locked test: eligible without failed gates, else rejected."""
    verify(record, files)
    if record["promotion_state"] != PENDING_TEST or not record.get("frozen_artifact") or record.get("locked_test_evaluation"):
        raise Invalid("not a frozen record that waits for its locked test")
    state = REJECTED if failures else ELIGIBLE
    gate = {"acceptance_gate": {"passed": not failures, "failures": failures, "promotion_state": state}}
    return verify(sealed(record | {"locked_test_evaluation": files.entry(scorecard), "release_gate_results": gate, "promotion_state": state}), files)


def refreshed(record: dict, files: Files) -> dict:
    """The record of the files as they are now: a new identity, nothing bound."""
    again = lambda e: e | {"sha256": files.hash_of(e)}
    held = {k: [again(e) for e in v] if k == "code" else again(v) for k, v in verify(record)["core"]["files"].items()}
    core = record["core"] | {"files": held}
    return sealed(record | {"core": core, "artifact_manifest_sha256": sha256_json(core), "calibration": None, "frozen_artifact": None, "locked_test_evaluation": None, "release_gate_results": None, "promotion_state": PENDING_CALIBRATION})


def disagreements(record: dict, files: Files, paths: dict[str, str | Path], label_mappings: dict, head_type: str, head_types: dict[str, str], want_types: dict[str, str], split_manifest: dict, data_manifest_sha256: str) -> list[str]:
    """Why a calibration may not use this record: its paths, labels, heads or data are others."""
    core = record.get("core", {})
    out = [f"path of {k}" for k, p in paths.items() if (files.root / core.get("files", {}).get(k, {}).get("path", "")).resolve() != Path(p).resolve()]
    out += [f"labels of {k}" for k, v in label_mappings.items() if core.get("label_mappings", {}).get(k) != v]
    out += ["head type"] if core.get("head_type") != head_type else []
    out += [f"head type of {k}" for k, v in want_types.items() if head_types.get(k) != v]
    return out + (["data manifest"] if split_manifest.get("canonical_data_manifest_sha256") != data_manifest_sha256 else [])
