"""Canonical columns: name, Spark type, source aliases, optional parser and fixed values."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = T.StructType(
    [
        T.StructField("file path", T.StringType()),
        T.StructField("row start", T.LongType()),
        T.StructField("row count", T.LongType()),
    ]
)
COLUMN_STAT = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
    ]
)
ANNOTATION = T.StructType(
    [T.StructField("column", T.StringType()), T.StructField("reason", T.StringType())]
)


def quoted(name: str) -> str:
    """Backticked reference: canonical names contain spaces, dots and brackets."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(str(name)))


@dataclass(frozen=True)
class ColumnSpec:
    """One canonical column.

    `parser` turns a raw column name into the canonical expression; without one the raw
    column is cast to `dtype`. `values` is an optional closed set of literals.
    """

    name: str
    dtype: T.DataType
    aliases: tuple[str, ...] = ()
    parser: Callable[[str], Column] | None = None
    values: tuple[str, ...] = ()

    def __str__(self) -> str:
        return self.name

    @property
    def candidates(self) -> tuple[str, ...]:
        return (self.name, *(a for a in self.aliases if a != self.name))

    def with_alias(self, *aliases: str) -> ColumnSpec:
        return replace(self, aliases=tuple(str(a) for a in aliases))

    def with_parser(self, parser: Callable[[str], Column]) -> ColumnSpec:
        return replace(self, parser=parser)

    def with_values(self, *values: str) -> ColumnSpec:
        return replace(self, values=values)

    def matching_name(self, columns: Iterable[str]) -> str | None:
        """First available column equal to the name or an alias, ignoring case."""
        folded = {c.casefold(): c for c in columns}
        return next((folded[c.casefold()] for c in self.candidates if c.casefold() in folded), None)

    def exact_sources(self, columns: Iterable[str]) -> tuple[str, ...]:
        """All available columns equal to the name or an alias, case-sensitive, alias order."""
        available = set(columns)
        return tuple(c for c in self.candidates if c in available)

    def expression(self, source: str) -> Column:
        parsed = self.parser(source) if self.parser else col(source).cast(self.dtype)
        return parsed.alias(self.name)

    def null(self) -> Column:
        return F.lit(None).cast(self.dtype).alias(self.name)

    def literal(self, value: object) -> Column:
        return F.lit(value).cast(self.dtype).alias(self.name)


_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()

# The canonical column names and reason texts of the data model.
DATASET_ID = ColumnSpec("dataset id", _S)
CELL_ID = ColumnSpec("cell id", _S)
CYCLE_INDEX = ColumnSpec("cycle index", _L)
TESTER_CYCLE_INDEX = ColumnSpec("Cycle index", _L)
PROTOCOL = ColumnSpec("protocol", _S, values=("cycling", "HPPC", "RPT", "EIS"))
SOC = ColumnSpec("SOC [%]", _D)
EIS_VOLTAGE = ColumnSpec("EIS voltage [V]", _D)
FILE_PATH = ColumnSpec("file path", _S)
ROW_START = ColumnSpec("row start", _L)
ROW_COUNT = ColumnSpec("row count", _L)
INGEST_ORDER = ColumnSpec("ingest order", _L)
SPLIT = ColumnSpec("split", _S, values=("train", "val"))
ANNOTATIONS = ColumnSpec("annotations", T.ArrayType(ANNOTATION))
RAW_PATHS = ColumnSpec("raw file paths", T.ArrayType(_S))
INGESTED_SEGMENTS = ColumnSpec("ingested segments", T.ArrayType(SEGMENT))
NORMALIZED_SEGMENTS = ColumnSpec("normalized segments", T.ArrayType(SEGMENT))
NORMALIZED_STATS = ColumnSpec("normalized stats", T.ArrayType(COLUMN_STAT))
RESAMPLING_METHOD = ColumnSpec("resampling method", _S)
RESAMPLING_PARAMS = ColumnSpec("resampling params", _S)
TIME_CONVENTION = ColumnSpec("time convention", _S)
PROCESSING_STAGE = ColumnSpec("processing stage", _S)
GIT_COMMIT = ColumnSpec("git commit", _S)
GIT_STATUS = ColumnSpec("git status", _S, values=("clean", "dirty", "na"))
MANIFEST_PATH = ColumnSpec("manifest path", _S)
PROTOCOLS = ColumnSpec("protocols", T.ArrayType(_S))

DEVICE = ColumnSpec("Device ID", _S)
TEST_ID = ColumnSpec("Test ID", _L)
CHANNEL = ColumnSpec("Channel ID", _L)
STEP_INDEX = ColumnSpec("Step index", _L)
STEP_TIME = ColumnSpec("Step time [s]", _D)
STEP_ID = ColumnSpec("Step ID", _L)
CYCLE_ID = ColumnSpec("Cycle ID", _L)
PT = ColumnSpec("Pt", _L)
NOMINAL_CAPACITY = ColumnSpec("Nominal capacity [Ah]", _D)

TIME = ColumnSpec("Time [s]", _D)
TIME_DIFF = ColumnSpec("Time diff [s]", _D)
DATE_TIME = ColumnSpec("Date time", T.TimestampNTZType())
CURRENT = ColumnSpec("Current [A]", _D)
C_RATE = ColumnSpec("Current [C-rate]", _D)
VOLTAGE = ColumnSpec("Terminal voltage [V]", _D)
AUX_TEMPERATURE_1 = ColumnSpec("Auxiliary temperature 1 [degC]", _D)
AUX_TEMPERATURE_2 = ColumnSpec("Auxiliary temperature 2 [degC]", _D)
AUX_TEMPERATURE_3 = ColumnSpec("Auxiliary temperature 3 [degC]", _D)
SURFACE_TEMPERATURE = ColumnSpec("Surface temperature [degC]", _D)
AMBIENT_TEMPERATURE = ColumnSpec("Ambient temperature [degC]", _D)
COOLING_ALPHA = ColumnSpec("Cooling alpha [W.m-2.K-1]", _D)
FREQUENCY = ColumnSpec("Frequency [Hz]", _D)
Z_MAGNITUDE = ColumnSpec("Impedance magnitude [Ohm]", _D)
Z_PHASE = ColumnSpec("Impedance phase [deg]", _D)
Z_REAL = ColumnSpec("Impedance real [Ohm]", _D)
Z_IMAGINARY = ColumnSpec("Impedance imaginary [Ohm]", _D)
CHARGE_CAPACITY = ColumnSpec("Charge capacity [Ah]", _D)
DISCHARGE_CAPACITY = ColumnSpec("Discharge capacity [Ah]", _D)
CHARGE_ENERGY = ColumnSpec("Charge energy [Wh]", _D)
DISCHARGE_ENERGY = ColumnSpec("Discharge energy [Wh]", _D)
RESISTANCE = ColumnSpec("Internal resistance [Ohm]", _D)
ACR = ColumnSpec("ACR [Ohm]", _D)
DVDT = ColumnSpec("dV/dt [V.s-1]", _D)

REASON_MISSING = "missing"
REASON_BELOW = "below column minimum"
REASON_ABOVE = "above column maximum"
REASON_DUPLICATE_TIME = "duplicate time steps"
REASON_BIG_DT = "big time diff"
REASON_INVALID_AXIS = "invalid domain x-axis"
# End of fixed values.

# Position of a row inside its task; our tables carry it so a stream needs no second ordering.
ROW_POSITION = ColumnSpec("row position", _L)
