"""Protocol specs: domain axis, task key and alternative required column groups."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from streamloom import columns as C
from streamloom.columns import ColumnSpec


@dataclass(frozen=True)
class ProtocolSpec:
    """`key_choice` picks one of `key_choices`, e.g. SOC or voltage for impedance spectra."""

    name: str
    axis: ColumnSpec
    base_key: tuple[ColumnSpec, ...] = (C.CELL_ID, C.CYCLE_INDEX)
    key_choices: tuple[tuple[ColumnSpec, ...], ...] = ()
    key_choice: tuple[ColumnSpec, ...] = ()
    one_of_groups: tuple[tuple[ColumnSpec, ...], ...] = ()

    def __post_init__(self) -> None:
        if self.key_choices and self.key_choice not in self.key_choices:
            raise ValueError(f"{self.name}: key_choice must be one of {self.key_choices}")
        if not self.key_choices and self.key_choice:
            raise ValueError(f"{self.name}: no task key alternatives declared")

    @property
    def task_key(self) -> tuple[ColumnSpec, ...]:
        return (*self.base_key, *self.key_choice)

    @property
    def key_names(self) -> list[str]:
        return [c.name for c in self.task_key]


CYCLING = ProtocolSpec("cycling", C.TIME)
HPPC = ProtocolSpec("HPPC", C.TIME)
RPT = ProtocolSpec("RPT", C.TIME)
EIS = ProtocolSpec(
    "EIS",
    C.FREQUENCY,
    key_choices=((C.SOC,), (C.EIS_VOLTAGE,)),
    key_choice=(C.SOC,),
    one_of_groups=((C.Z_MAGNITUDE, C.Z_PHASE), (C.Z_REAL, C.Z_IMAGINARY)),
)
EIS_BY_VOLTAGE = replace(EIS, key_choice=(C.EIS_VOLTAGE,))

# Protocol order used when several protocols of one cell are chained.
PROTOCOL_RANK = {"cycling": 0, "HPPC": 1, "RPT": 2, "EIS": 3}


def protocol_name(value: object) -> str:
    """Canonical label of a protocol spec, label or lower-case member name."""
    text = value.name if isinstance(value, ProtocolSpec) else str(value)
    for label in PROTOCOL_RANK:
        if text == label or text == label.lower():
            return label
    raise ValueError(f"Unknown protocol: {text!r}")


@dataclass(frozen=True)
class MetadataLayout:
    """Required metadata columns plus optional ones with default values."""

    required: tuple[ColumnSpec, ...] = ()
    optional: dict[ColumnSpec, object] = field(default_factory=dict)

    @property
    def columns(self) -> tuple[ColumnSpec, ...]:
        return (*self.required, *self.optional)

    def with_optional(self, extra: dict[ColumnSpec, object]) -> MetadataLayout:
        return MetadataLayout(self.required, {**self.optional, **extra})

    def with_protocols(self, protocols: Iterable[ProtocolSpec]) -> MetadataLayout:
        known = {c.name for c in self.columns}
        keys = {c.name: c for p in protocols for c in p.task_key if c.name not in known}
        return self.with_optional({c: None for c in keys.values()})

    def check(self, available: Iterable[str], context: str) -> None:
        present = set(available)
        missing = [c.name for c in self.columns if c.name not in present]
        if missing:
            raise ValueError(f"{context} is missing metadata columns: {missing}")

    def __hash__(self) -> int:
        return hash((self.required, tuple(c.name for c in self.optional)))


INGEST_MANIFEST = MetadataLayout((C.RAW_PATHS, C.INGESTED_SEGMENTS, C.ROW_COUNT, C.PROTOCOL))
NORMALIZE_MANIFEST = MetadataLayout(
    (C.NORMALIZED_SEGMENTS, C.ROW_COUNT, C.PROTOCOL), {C.NORMALIZED_STATS: None}
)
PROVENANCE = MetadataLayout(
    (C.DATASET_ID, C.PROCESSING_STAGE, C.GIT_COMMIT, C.GIT_STATUS, C.MANIFEST_PATH)
)
