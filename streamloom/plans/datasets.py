"""Registered data sets: column aliases, checks and resampling per protocol."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from streamloom import columns as C
from streamloom.columns import ColumnSpec
from streamloom.functions.derive import CRate
from streamloom.functions.values import parse_datetime
from streamloom.operators.align import IngestSpec
from streamloom.operators.checks import (
    AxisCheck,
    BoundsCheck,
    ImpedanceCheck,
    MissingCheck,
    TimeCheck,
)
from streamloom.operators.resample import GridResampling, MinMaxLTTB
from streamloom.protocols import CYCLING, EIS, EIS_BY_VOLTAGE, HPPC, RPT, ProtocolSpec


@dataclass(frozen=True)
class NormalizeSpec:
    """One protocol's normalization; order defaults to the protocol's axis."""

    protocol: ProtocolSpec
    columns: tuple[ColumnSpec, ...] = ()
    constants: tuple[tuple[ColumnSpec, object], ...] = ()
    transforms: tuple = ()
    checks: tuple = ()
    resampling: MinMaxLTTB | GridResampling | None = None
    order_by: tuple[ColumnSpec, ...] = ()

    @property
    def order(self) -> tuple[ColumnSpec, ...]:
        return self.order_by or (self.protocol.axis,)

    @property
    def output_columns(self) -> tuple[ColumnSpec, ...]:
        return tuple(
            {c.name: c for c in (*self.order, *self.columns, *(c for c, _ in self.constants))}.values()
        )

    @property
    def produced(self) -> set[str]:
        made = {c.name for c, _ in self.constants}
        for step in (*self.transforms, *self.checks):
            made.update(step.produced)
        return made

    @property
    def required_inputs(self) -> tuple[str, ...]:
        """Columns the recipe needs and does not produce before needing them."""
        names = [c.name for c in self.order]
        names += [n for t in self.transforms for n in t.inputs]
        names += [c.name for c in self.columns if c.name not in self.produced]
        made = {c.name for c, _ in self.constants} | {n for t in self.transforms for n in t.produced}
        for check in self.checks:
            names += [n for n in check.inputs if n not in made]
            made.update(check.produced)
        if self.resampling is not None:
            names += list(self.resampling.inputs)
        return tuple(dict.fromkeys(names))


def override_resampling(
    specs: Sequence[NormalizeSpec], values: dict[str, float | None]
) -> list[NormalizeSpec]:
    """Per protocol: None turns resampling off, a value below 1 is a ratio, else points."""
    out = []
    for spec in specs:
        name = spec.protocol.name
        if name not in values:
            out.append(spec)
            continue
        value = values[name]
        if value is None:
            changed = None
        elif spec.resampling is None:
            raise ValueError(f"{name} has no resampling to override")
        elif isinstance(spec.resampling, GridResampling):
            changed = replace(spec.resampling, points=int(value))
        elif value < 1:
            changed = replace(spec.resampling, points=None, points_ratio=float(value))
        else:
            changed = replace(spec.resampling, points=int(value), points_ratio=None)
        out.append(replace(spec, resampling=changed))
    return out


@dataclass(frozen=True)
class DatasetSpec:
    dataset_id: str
    dataset_type: str
    ingest: tuple[IngestSpec, ...]
    normalize: tuple[NormalizeSpec, ...]
    include: tuple[str, ...] = ("*",)
    exclude: tuple[str, ...] = ()
    info: dict = field(default_factory=dict)

    def stage_root(self, stage: str) -> str:
        return f"type={self.dataset_type}/dataset={self.dataset_id}/source={stage}"

    def ingest_spec(self, protocol: str) -> IngestSpec:
        return _declared(self.ingest, protocol)

    def normalize_spec(self, protocol: str) -> NormalizeSpec:
        return _declared(self.normalize, protocol)

    def __hash__(self) -> int:
        return hash(self.dataset_id)


def _declared(specs: Sequence, protocol: str):
    for spec in specs:
        if spec.protocol.name == protocol:
            return spec
    raise ValueError(f"Protocol {protocol!r} is not declared")


# Fixed values from here on: vendor column names, limits and point budgets of the data sets.
_RAW_TIME_SERIES = (
    C.TIME.with_alias("Test_Time(s)", "Test Time (s)"),
    C.DATE_TIME.with_alias("Date_Time").with_parser(parse_datetime()),
    C.CURRENT.with_alias("Current(A)", "Current (A)"),
    C.VOLTAGE.with_alias("Voltage(V)", "Voltage (V)"),
    C.AUX_TEMPERATURE_1.with_alias("Aux_Temperature(¡æ)_1"),
    C.AUX_TEMPERATURE_2.with_alias("Aux_Temperature(¡æ)_2"),
    C.AUX_TEMPERATURE_3.with_alias("Aux_Temperature(¡æ)_3"),
    C.CHARGE_CAPACITY.with_alias("Charge_Capacity(Ah)", "Charge Capacity (Ah)"),
    C.DISCHARGE_CAPACITY.with_alias("Discharge_Capacity(Ah)", "Discharge Capacity (Ah)"),
    C.CHARGE_ENERGY.with_alias("Charge_Energy(Wh)", "Charge Energy (Wh)"),
    C.DISCHARGE_ENERGY.with_alias("Discharge_Energy(Wh)", "Discharge Energy (Wh)"),
    C.RESISTANCE.with_alias("Internal Resistance(Ohm)", "Internal Resistance (Ohm)"),
    C.ACR.with_alias("ACR (Ohm)", "ACR(Ohm)"),
    C.DVDT.with_alias("dV/dt(V/s)", "dV/dt (V/s)"),
    C.DEVICE.with_alias("Device_ID"),
    C.TEST_ID.with_alias("Test_ID"),
    C.CHANNEL.with_alias("Channel_ID"),
    C.TESTER_CYCLE_INDEX.with_alias("Cycle_Index", "Cycle Index"),
    C.CYCLE_ID.with_alias("Cycle_ID"),
    C.STEP_ID.with_alias("Step_ID"),
    C.PT,
    C.STEP_TIME.with_alias("Step_Time(s)", "Step Time (s)"),
    C.STEP_INDEX.with_alias("Step_Index", "Step Index"),
)
_DROPPED_TIME_SERIES = (
    ColumnSpec("dropped Current", T.DoubleType(), ("Current",)),
    ColumnSpec("dropped Voltage", T.DoubleType(), ("Voltage",)),
)
_RAW_IMPEDANCE = (
    C.FREQUENCY.with_alias("Freq"),
    C.Z_MAGNITUDE.with_alias("Zmod"),
    C.Z_PHASE.with_alias("Zphz"),
    C.Z_REAL.with_alias("Zreal"),
    C.Z_IMAGINARY.with_alias("imaginary"),
    C.DEVICE.with_alias("Device_ID"),
    C.TEST_ID.with_alias("Test_ID"),
    C.CHANNEL.with_alias("Channel_ID"),
    C.CYCLE_ID.with_alias("Cycle_ID"),
    C.STEP_ID.with_alias("Step_ID"),
    C.PT,
    C.STEP_TIME.with_alias("Step_Time(s)", "Step Time (s)"),
    C.STEP_INDEX.with_alias("Step_Index", "Step Index"),
)
_SURFACE = C.SURFACE_TEMPERATURE.with_alias(
    C.AUX_TEMPERATURE_2.name, C.AUX_TEMPERATURE_1.name, C.AUX_TEMPERATURE_3.name
)
_IMPEDANCE = (C.Z_MAGNITUDE, C.Z_PHASE, C.Z_REAL, C.Z_IMAGINARY)
_IMPEDANCE_CHECKS = (
    ImpedanceCheck(),
    MissingCheck(),
    AxisCheck(C.FREQUENCY.name, zero_replacement=1e-7, enforce_positive=True),
)
_AMBIENT = ((C.AMBIENT_TEMPERATURE, 20.0), (C.COOLING_ALPHA, 20.0))


def _published_time(protocol: ProtocolSpec, **budget) -> NormalizeSpec:
    return NormalizeSpec(
        protocol,
        columns=(C.TIME_DIFF, C.C_RATE, C.VOLTAGE, _SURFACE),
        constants=_AMBIENT,
        transforms=(CRate(5.0),),
        checks=(
            MissingCheck((C.C_RATE.name, C.VOLTAGE.name, C.SURFACE_TEMPERATURE.name)),
            TimeCheck(),
            BoundsCheck.of(
                {
                    C.C_RATE.name: (-50.0, 50.0),
                    C.VOLTAGE.name: (2.3, 4.6),
                    C.SURFACE_TEMPERATURE.name: (15.0, 55.0),
                }
            ),
        ),
        resampling=MinMaxLTTB(C.TIME.name, C.VOLTAGE.name, **budget),
    )


def _synthetic_time(protocol: ProtocolSpec, **budget) -> NormalizeSpec:
    names = (C.C_RATE, C.VOLTAGE, C.SURFACE_TEMPERATURE, C.AMBIENT_TEMPERATURE, C.COOLING_ALPHA)
    return NormalizeSpec(
        protocol,
        columns=(C.TIME_DIFF, *names),
        checks=(
            MissingCheck(tuple(c.name for c in names)),
            TimeCheck(),
            BoundsCheck.of(
                {
                    C.C_RATE.name: (-50.0, 50.0),
                    C.VOLTAGE.name: (2.3, 4.6),
                    C.SURFACE_TEMPERATURE.name: (5.0, 65.0),
                    C.AMBIENT_TEMPERATURE.name: (0.0, 50.0),
                    C.COOLING_ALPHA.name: (1.0, 50.0),
                }
            ),
        ),
        resampling=MinMaxLTTB(C.TIME.name, C.VOLTAGE.name, **budget),
    )


POZZATO_2022 = DatasetSpec(
    dataset_id="pozzato-2022",
    dataset_type="published",
    include=("*.csv",),
    exclude=("*/README.csv",),
    ingest=(
        IngestSpec(CYCLING, _RAW_TIME_SERIES, _DROPPED_TIME_SERIES, flip_current_sign=True),
        IngestSpec(HPPC, _RAW_TIME_SERIES, _DROPPED_TIME_SERIES, flip_current_sign=True),
        IngestSpec(RPT, _RAW_TIME_SERIES, _DROPPED_TIME_SERIES, flip_current_sign=True),
        IngestSpec(EIS, _RAW_IMPEDANCE),
    ),
    normalize=(
        _published_time(CYCLING, points_ratio=0.1),
        _published_time(HPPC, points=16_384),
        _published_time(RPT, points=4096),
        NormalizeSpec(
            EIS,
            columns=_IMPEDANCE,
            constants=_AMBIENT,
            checks=_IMPEDANCE_CHECKS,
            resampling=GridResampling(C.FREQUENCY.name, 48, "log"),
        ),
    ),
    info={"name": "Pozzato 2022", "year": 2022, "doi": "10.1016/j.dib.2022.107995"},
)

_SYNTHETIC_RAW = (
    C.TIME,
    C.CURRENT,
    C.C_RATE,
    C.VOLTAGE,
    C.SURFACE_TEMPERATURE.with_alias("Auxiliary temperature [degC]"),
    ColumnSpec("Core temperature [degC]", T.DoubleType()),
    ColumnSpec("Cumulative throughput [Ah]", T.DoubleType()),
    C.AMBIENT_TEMPERATURE,
    C.COOLING_ALPHA,
)
SYNTHETIC_M50T = DatasetSpec(
    dataset_id="synthetic-pozzato-2022-m50t",
    dataset_type="synthetic",
    include=("*.parquet",),
    ingest=(
        IngestSpec(CYCLING, _SYNTHETIC_RAW, manifest_columns=(C.NOMINAL_CAPACITY,)),
        IngestSpec(RPT, _SYNTHETIC_RAW, manifest_columns=(C.NOMINAL_CAPACITY,)),
        IngestSpec(
            EIS_BY_VOLTAGE,
            (C.FREQUENCY, C.Z_REAL, C.Z_IMAGINARY),
            manifest_columns=(C.NOMINAL_CAPACITY,),
        ),
    ),
    normalize=(
        _synthetic_time(CYCLING, points_ratio=0.6),
        _synthetic_time(RPT, points=1024),
        NormalizeSpec(
            EIS_BY_VOLTAGE,
            columns=_IMPEDANCE,
            checks=_IMPEDANCE_CHECKS,
            resampling=GridResampling(C.FREQUENCY.name, 32, "log"),
        ),
    ),
    info={"name": "Synthetic Pozzato 2022 M50T", "parent": "pozzato-2022"},
)
DATASETS = {d.dataset_id: d for d in (POZZATO_2022, SYNTHETIC_M50T)}


def dataset(dataset_id: str) -> DatasetSpec:
    if dataset_id not in DATASETS:
        raise ValueError(f"Unknown dataset {dataset_id!r}; known: {sorted(DATASETS)}")
    return DATASETS[dataset_id]
