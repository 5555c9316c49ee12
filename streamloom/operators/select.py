"""Row selection and validation of manifests, batches and indexes."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom import columns as C
from streamloom.columns import col
from streamloom.protocols import ProtocolSpec, protocol_name

log = logging.getLogger(__name__)

_SAMPLE = 20  # Rows quoted in an error message.


def as_values(value: object) -> tuple | None:
    """None stays None; a scalar or string becomes a one-element tuple."""
    if value is None:
        return None
    if isinstance(value, (list, tuple, set, frozenset)):
        return tuple(value)
    return (value,)


def selection_condition(
    group_columns: Sequence[str], protocols: object = None, group_values: object = None
) -> Column:
    """Protocol IN (...) and, over the selectors, OR of (column IN (...) and ...)."""
    if group_values is None:
        selectors: list[Mapping] = [{}]
    elif isinstance(group_values, Mapping):
        selectors = [group_values]
    elif isinstance(group_values, (list, tuple)):
        if not group_values:
            raise ValueError("group_values needs at least one selector")
        selectors = list(group_values)
    else:
        raise TypeError("group_values must be a mapping, a list of mappings or None")
    per_selector = []
    for selector in selectors:
        if not isinstance(selector, Mapping):
            raise TypeError("group_values entries must be mappings")
        unknown = [str(k) for k in selector if str(k) not in group_columns]
        if unknown:
            raise ValueError(f"Unknown group columns {unknown}; expected {list(group_columns)}")
        terms = [
            col(str(k)).isin(*as_values(v)) for k, v in selector.items() if v is not None
        ]
        if terms:
            per_selector.append(reduce(lambda a, b: a & b, terms))
    condition = F.lit(True)
    wanted = as_values(protocols)
    if wanted is not None:
        condition = col(C.PROTOCOL.name).cast("string").isin(*[str(p) for p in wanted])
    if per_selector:
        condition = condition & reduce(lambda a, b: a | b, per_selector)
    return condition


def select_manifest(
    manifest: DataFrame,
    group_columns: Sequence[str],
    protocols: object = None,
    group_values: object = None,
) -> DataFrame:
    """Matching manifest rows; no match is an error."""
    rows = manifest.filter(selection_condition(group_columns, protocols, group_values))
    if rows.isEmpty():
        raise ValueError(f"No row matched protocols={protocols!r} group_values={group_values!r}")
    return rows


def manifest_inputs(manifest: DataFrame, protocols: Sequence[ProtocolSpec]) -> DataFrame:
    """Distinct (protocol, task key) selectors present, with their place in the protocol order."""
    keys = list(dict.fromkeys(k for p in protocols for k in p.key_names if k in manifest.columns))
    order = F.array_position(
        F.array(*[F.lit(p.name) for p in protocols]), col(C.PROTOCOL.name)
    )
    return manifest.select(
        col(C.PROTOCOL.name), *[col(k) for k in keys], order.alias("protocol order")
    ).distinct()


def select_row_ids(df: DataFrame, id_column: str, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Rows whose id is listed; an empty list selects nothing. Large id sets come as a table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(col(id_column)).distinct(), id_column, "left_semi")
    wanted = list(ids)
    return df.filter(col(id_column).isin(*wanted)) if wanted else df.limit(0)


def viewport_condition(
    x: str,
    y: str,
    x_range: tuple[float, float] | None = None,
    y_range: tuple[float, float] | None = None,
) -> Column:
    """Inclusive bounds on both axes; the bounds of each pair may come in either order."""
    condition = F.lit(True)
    for name, bounds in ((x, x_range), (y, y_range)):
        if bounds is not None:
            condition = condition & col(name).between(min(bounds), max(bounds))
    return condition


def filter_split(index: DataFrame, split: str) -> DataFrame:
    return index.filter(col(C.SPLIT.name) == split)


def protocol_availability(index: DataFrame, protocols: Sequence[object]) -> DataFrame:
    """Per dataset: protocols present and requested protocols missing."""
    requested = F.array(*[F.lit(protocol_name(p)) for p in protocols])
    present = F.array_sort(F.collect_set(col(C.PROTOCOL.name)))
    return index.groupBy(col(C.DATASET_ID.name)).agg(present.alias("available")).select(
        col(C.DATASET_ID.name),
        "available",
        F.array_except(requested, "available").alias("missing"),
    )


def filter_protocols(
    index: DataFrame, protocols: Sequence[object] | None, mode: str = "strict"
) -> DataFrame:
    """Rows of the requested protocols.

    strict: every dataset must have all of them; available: missing ones are logged. A dataset
    that has none of them is always an error.
    """
    if protocols is None:
        return index
    check_protocols(index, protocols, mode)
    return index.filter(col(C.PROTOCOL.name).isin(*[protocol_name(p) for p in protocols]))


def check_protocols(index: DataFrame, protocols: Sequence[object], mode: str = "strict") -> None:
    """Fail when a requested protocol is absent in a way the mode does not allow."""
    if mode not in ("strict", "available"):
        raise ValueError(f"mode must be 'strict' or 'available', got {mode!r}")
    if not protocols:
        raise ValueError("protocols must not be empty when given")
    names = [protocol_name(p) for p in protocols]
    worst_first = F.size("missing").desc()
    gaps = protocol_availability(index, protocols).orderBy(worst_first).limit(_SAMPLE).collect()
    if not gaps:
        raise ValueError(f"No rows remain after protocol selection {names}")
    for row in gaps:
        text = f"dataset={row[0]!r} missing={row['missing']} available={row['available']}"
        if row["missing"] and (mode == "strict" or len(row["missing"]) == len(set(names))):
            raise ValueError(f"Requested protocols not found: {text}")
        if row["missing"]:
            log.warning("Using the available protocols only: %s", text)


def provided_groups(
    groups: DataFrame, selectors: Sequence[Mapping[str, object]], group_by: Sequence[str]
) -> DataFrame:
    """Distinct groups matching any partial selector; each selector must match something."""
    found = None
    for selector in selectors:
        terms = {str(k): as_values(v) for k, v in selector.items()}
        unknown = sorted(set(terms) - set(group_by))
        if unknown:
            raise ValueError(f"Selector has unknown group columns: {unknown}")
        if not terms:
            raise ValueError("Selector must not be empty")
        match = groups.filter(
            reduce(lambda a, b: a & b, [col(k).isin(*v) for k, v in terms.items()])
        )
        if match.isEmpty():
            raise ValueError(f"Selector did not match any group: {terms}")
        found = match if found is None else found.unionByName(match)
    chosen = groups.limit(0) if found is None else found.distinct()
    return chosen.select(*[col(c) for c in group_by])


def batch_metadata_errors(df: DataFrame, spec: ProtocolSpec) -> DataFrame:
    """Rows whose protocol differs or whose task key has nulls."""
    missing = reduce(lambda a, b: a | b, [col(k).isNull() for k in spec.key_names])
    wrong = col(C.PROTOCOL.name).isNull() | (col(C.PROTOCOL.name) != spec.name)
    problem = F.when(wrong, "protocol mismatch").when(missing, "missing task key")
    return df.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def require_no_rows(df: DataFrame, message: str) -> None:
    """Fail with a few sample rows when a violation table is not empty."""
    sample = df.limit(_SAMPLE).collect()
    if sample:
        raise ValueError(f"{message}: {[r.asDict(recursive=True) for r in sample]}")


CANONICAL_SEGMENT = r"^type=[^/]*/dataset=[^/]*/source=normalized/.+"
CANONICAL_MANIFEST = r"^type=[^/]*/dataset=[^/]*/source=normalized/manifest\.parquet$"


def non_canonical_segments(manifest: DataFrame, segments: str) -> DataFrame:
    """Segment paths outside `type=*/dataset=*/source=normalized/…`."""
    path = F.explode(F.transform(col(segments), lambda s: s["file path"]))
    return manifest.select(path.alias("file path")).filter(
        ~F.coalesce(F.col("`file path`").rlike(CANONICAL_SEGMENT), F.lit(False))
    )


def revision_problems(manifest: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(manifest path, problem) for each manifest whose recorded revision is not acceptable."""
    for path, commit in expected.items():
        if len(commit.strip()) < 7:
            raise ValueError(f"Expected commit for {path!r} needs at least 7 characters")
    wanted = F.create_map(*[F.lit(x.strip()) for item in expected.items() for x in item])
    commit, status = col(C.GIT_COMMIT.name), col(C.GIT_STATUS.name)
    unknown = lambda c: c.isNull() | c.isin("", "na")
    prefix = F.element_at(wanted, col(C.MANIFEST_PATH.name))
    problem = (
        F.when(unknown(commit), "no git commit")
        .when(unknown(status), "no git status")
        .when(~F.coalesce(F.startswith(commit, prefix), F.lit(False)), "git commit mismatch")
        .when(status != "clean", "dirty")
    )
    rows = manifest.select(col(C.MANIFEST_PATH.name), commit, status, problem.alias("problem"))
    return rows.distinct().filter(F.col("problem").isNotNull())


def check_revisions(manifest: DataFrame, expected: Mapping[str, str]) -> None:
    """Mismatching or unknown revisions fail; a dirty worktree is only logged."""
    problems = revision_problems(manifest, expected)
    require_no_rows(problems.filter(F.col("problem") != "dirty"), "Manifest revision")
    for row in problems.filter(F.col("problem") == "dirty").limit(_SAMPLE).collect():
        log.warning("Manifest %s comes from a dirty worktree", row[0])


def revision_listing(manifest: DataFrame) -> DataFrame:
    """Manifest path and the seven-character commit prefix it records."""
    return manifest.select(
        col(C.MANIFEST_PATH.name), F.substring(col(C.GIT_COMMIT.name), 1, 7).alias("commit")
    ).distinct()


def require_columns(columns: Sequence[str], required: Iterable[str], context: str) -> None:
    missing = [c for c in required if c not in set(columns)]
    if missing:
        raise ValueError(f"{context} is missing columns: {missing}")


def with_dataset_id(manifest: DataFrame, manifest_path: str) -> DataFrame:
    """Ensure `dataset id`: the one id in the column, else the one in the path."""
    name = C.DATASET_ID.name
    if name in manifest.columns:
        ids = [r[0] for r in manifest.select(col(name)).dropna().distinct().limit(2).collect()]
        if len(ids) > 1:
            raise ValueError(f"Manifest has multiple dataset ids: {manifest_path!r}")
        if ids:
            return manifest
    parts = [p for p in manifest_path.split("/") if p.startswith("dataset=")]
    if not parts or parts[0] == "dataset=":
        raise ValueError(f"Could not infer the dataset id of {manifest_path!r}")
    return manifest.withColumn(name, F.lit(parts[0].removeprefix("dataset=")))


def check_model_columns(
    inputs: Sequence[str],
    targets: Sequence[str],
    feedback: Sequence[str],
    scaled: Sequence[str],
) -> None:
    """No duplicates, scaling rules exactly for the used columns, feedback in inputs and targets."""
    for label, names in (("input", inputs), ("target", targets), ("feedback", feedback)):
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate {label} columns: {list(names)}")
    used = set(inputs) | set(targets)
    if set(scaled) != used:
        raise ValueError(f"scaling rules and columns differ: {sorted(set(scaled) ^ used)}")
    outside = set(feedback) - (set(inputs) & set(targets))
    if outside:
        raise ValueError(f"feedback columns must be inputs and targets: {sorted(outside)}")


def selected_protocols(index: DataFrame, configured: Sequence[str]) -> list[str]:
    """Distinct protocols of the selected streams; impedance or unconfigured ones are errors."""
    names = [r[0] for r in index.select(col(C.PROTOCOL.name)).distinct().collect()]
    if "EIS" in names:
        raise ValueError("EIS streams cannot be scored")
    extra = sorted(set(names) - set(configured))
    if extra:
        raise ValueError(f"Protocols not configured: {extra}")
    return sorted(names)


def single_stream_matches(index: DataFrame, selectors: DataFrame, on: Sequence[str]) -> DataFrame:
    """Selectors (with a `selector` id) that do not match exactly one stream, with their count."""
    hits = selectors.join(index, list(on), "left").groupBy("selector").agg(
        F.count(col(C.ROW_COUNT.name)).alias("matches")
    )
    return hits.filter(F.col("matches") != 1)
