"""Driver-side decisions: selection configuration, gates, prompts and modes. Small data only."""

from __future__ import annotations

import json
from dataclasses import dataclass

# --- Fixed values ---
MODES = ("auto", "calibrated", "legacy", "argmax")
CALIBRATION_SCHEMA, LEGACY_SCHEMAS, LEGACY_HEAD = "calibration/v3", (1, 2, "calibration/v1", "calibration/legacy-v1"), "legacy_flat_v1"
STATES = ("pending_calibration", "pending_locked_test", "eligible", "rejected")


@dataclass(frozen=True)
class Region:
    """One side of a calibrated head: a threshold, or why there is none."""

    enabled: bool
    threshold: float | None = None
    reason: str | None = None


@dataclass(frozen=True)
class Head:
    """Lower and upper region of a score; the lower one is asked first."""

    lower: Region
    upper: Region

    def __post_init__(self):
        if self.lower.enabled and self.upper.enabled and not self.lower.threshold < self.upper.threshold:
            raise ValueError("the lower threshold must be below the upper one")

    def state(self, p: float, names: tuple[str, str, str] = ("clear_non_bias", "possible_bias", "clear_bias")) -> str:
        if self.lower.enabled and p <= self.lower.threshold:
            return names[0]
        return names[2] if self.upper.enabled and p >= self.upper.threshold else names[1]


@dataclass(frozen=True)
class HeadGate:
    """A head of a calibration: its threshold, or why it has none."""

    threshold: float | None = None
    temperature: float = 1.0
    reason: str | None = None

    @property
    def enabled(self) -> bool:
        return self.reason is None


def head_gate(data: dict | None, override: float | None = None) -> HeadGate:
    """A legacy calibration's entry for a head; an override enables it whatever the entry says."""
    data = data or ({} if override is not None else {"disabled_reason": "missing_calibration_head"})
    temperature, threshold = float(data.get("temperature", 1.0)), data.get("threshold") if override is None else override
    if temperature <= 0:
        raise ValueError("a temperature must be positive")
    if threshold is not None and not 0 <= float(threshold) <= 1:
        raise ValueError("a threshold must lie between 0 and 1")
    if threshold is None:
        return HeadGate(None, temperature, data.get("disabled_reason") or "missing_threshold")
    off = override is None and not data.get("enabled", True)
    return HeadGate(float(threshold), temperature, (data.get("disabled_reason") or "disabled") if off else None)


@dataclass(frozen=True)
class Selection:
    """How sentences are selected: ``effective`` is argmax, calibrated or legacy_calibrated."""

    requested: str
    effective: str
    reason: str
    gates: dict[str, HeadGate] | None = None

    @property
    def compatible(self) -> bool:
        return self.effective != "calibrated"


def resolve_selection(requested: str, calibration: dict | None, *, labels: dict[str, dict[str, int]] | None = None, head_type: str = LEGACY_HEAD, overrides: dict[str, float] | None = None, disagreements: list[str] | None = None) -> Selection:
    """The selection that a request leads to; what can't be met is an error, never another mode.

    ``auto`` and ``calibrated`` need a strict calibration bound to its artifact:
    ``disagreements`` holds what keeps it from that (none if empty; None if nothing was
    checked). ``legacy`` takes any known schema whose labels and head type, where it
    states them, are the model's. Thresholds can be overridden in legacy mode only.
    """
    if requested not in MODES:
        raise ValueError(f"unknown mode: {requested!r}")
    overrides = {k: v for k, v in (overrides or {}).items() if v is not None}
    if overrides and requested != "legacy":
        raise ValueError("threshold overrides need the legacy mode")
    if requested == "argmax":
        return Selection(requested, "argmax", "legacy_argmax_requested")
    if calibration is None:
        raise ValueError("no calibration; only argmax does without")
    if requested != "legacy":
        if calibration.get("schema_version") != CALIBRATION_SCHEMA:
            raise ValueError("not a strict calibration")
        if disagreements is None or disagreements:
            raise ValueError(f"calibration isn't bound to its artifact: {disagreements or 'not checked'}")
        return Selection(requested, "calibrated", "manifest_bound_calibration_loaded")
    if calibration.get("schema_version") not in (*LEGACY_SCHEMAS, CALIBRATION_SCHEMA):
        raise ValueError("unsupported calibration schema")
    stated = calibration.get("label_mappings") or {}
    for head, own in (labels or {}).items():
        if stated.get(f"{head}_label2id", own) != own:
            raise ValueError(f"labels of {head} differ from the model's")
    if calibration.get("head_type", LEGACY_HEAD) != head_type:
        raise ValueError("head type differs from the model's")
    heads = calibration.get("heads") or calibration.get("selection") or {}
    return Selection(requested, "legacy_calibrated", "legacy_calibration_requested", {k: head_gate(heads.get(k), overrides.get(k)) for k in ("bias", "opinion", "report_trigger")})


def next_state(state: str, *, calibrated: bool = False, gates_failed: list[str] | None = None) -> str:
    """Promotion of an artifact; final states stay."""
    if state == "pending_calibration" and calibrated:
        return "pending_locked_test"
    if state == "pending_locked_test" and gates_failed is not None:
        return "rejected" if gates_failed else "eligible"
    return state


def retrieval_failures(recall: float, irrelevant: float | None, coverage: float, p95_seconds: float) -> list[str]:
    out = []
    if recall < 0.80:
        out.append("recall_at_5_below_minimum")
    if irrelevant is None or irrelevant > 0.30:
        out.append("irrelevant_at_5_above_maximum")
    if coverage < 0.80:
        out.append("coverage_at_10_below_minimum")
    if p95_seconds > 10:
        out.append("hybrid_p95_above_maximum")
    return out


def evidence_prompt(claims: list[dict]) -> str:
    """A deterministic prompt: claims with their citations as JSON."""
    return "Assess these claims against only their supplied evidence:\n" + json.dumps(claims, ensure_ascii=False, indent=2)


def one_shot(path: str) -> None:
    """Creates a marker file or fails: something that may run only once."""
    import os

    os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
