"""Derived measurement columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import col


@dataclass(frozen=True)
class CRate:
    """Current divided by nominal capacity; fills only nulls of an existing target column."""

    nominal_capacity_ah: float
    source: str = C.CURRENT.name
    target: str = C.C_RATE.name

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.source,)

    @property
    def produced(self) -> tuple[str, ...]:
        return (self.target,)

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.source not in df.columns:
            return df
        derived = col(self.source).cast("double") / F.lit(float(self.nominal_capacity_ah))
        value = F.coalesce(col(self.target), derived) if self.target in df.columns else derived
        return df.withColumn(self.target, value)


@dataclass(frozen=True)
class ImpedanceComponents:
    """Polar and rectangular impedance from each other; existing values win."""

    real: str = C.Z_REAL.name
    imaginary: str = C.Z_IMAGINARY.name
    magnitude: str = C.Z_MAGNITUDE.name
    phase: str = C.Z_PHASE.name

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.real, self.imaginary, self.magnitude, self.phase)

    @property
    def produced(self) -> tuple[str, ...]:
        return self.inputs

    def __call__(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        polar = {self.magnitude, self.phase} <= have
        rectangular = {self.real, self.imaginary} <= have
        if not polar and not rectangular:
            raise ValueError(f"impedance needs (real, imaginary) or (magnitude, phase): {have}")
        derived = {}
        if polar:
            angle = F.radians(col(self.phase))
            derived[self.real] = col(self.magnitude) * F.cos(angle)
            derived[self.imaginary] = col(self.magnitude) * F.sin(angle)
        if rectangular:
            re, im = col(self.real), col(self.imaginary)
            derived[self.magnitude] = F.sqrt(re * re + im * im)
            derived[self.phase] = F.degrees(F.atan2(im, re))
        return df.withColumns(
            {n: F.coalesce(col(n), e) if n in have else e for n, e in derived.items()}
        )


def negate(df: DataFrame, column: str) -> DataFrame:
    """Sign flip of a column when it is present (charge-positive currents, Nyquist axes)."""
    return df.withColumn(column, -col(column)) if column in df.columns else df


def replace_zero(df: DataFrame, column: str, value: float) -> DataFrame:
    """Zero axis values become a small positive one."""
    return df.withColumn(column, F.when(col(column) == 0, F.lit(value)).otherwise(col(column)))
