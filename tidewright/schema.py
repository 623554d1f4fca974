"""Value objects at the boundary: column map, label space, fold scheme, endpoints and adapters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.endpoints import class_correspondence, context_sensitivity, context_specificity, directional_alignment
from tidewright.sources.tables import CLASSES, require_columns

KEY = re.compile("^[a-z][a-z0-9_]*$")


@dataclass(frozen=True)
class Dimension:
    """One output dimension: key, shown name and definition."""

    key: str
    name: str = ""
    definition: str = ""

    def __post_init__(self) -> None:
        if not KEY.match(self.key):
            raise ValueError(f"no valid dimension key: {self.key!r}")


@dataclass(frozen=True)
class LabelSpace:
    """The ordered dimensions; keys and shown names are unique."""

    dimensions: tuple[Dimension, ...]

    def __post_init__(self) -> None:
        keys, names = [d.key for d in self.dimensions], [d.name or d.key for d in self.dimensions]
        if not keys:
            raise ValueError("a label space needs a dimension")
        if len(set(keys)) < len(keys) or len(set(names)) < len(names):
            raise ValueError("dimension keys and names must be unique")

    @classmethod
    def of(cls, keys: list[str] = CLASSES) -> LabelSpace:
        return cls(tuple(Dimension(k, k.replace("_", " ")) for k in keys))

    @property
    def keys(self) -> list[str]:
        return [d.key for d in self.dimensions]

    def key_of(self, name: str) -> str:
        """The key of an exact key or shown name."""
        for d in self.dimensions:
            if name in (d.key, d.name):
                return d.key
        raise KeyError(name)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d.key, d.name, d.definition, i) for i, d in enumerate(self.dimensions)], "category string, name string, definition string, position int")


@dataclass(frozen=True)
class ColumnMap:
    """Where a source keeps patient, observer and item, and how many observers a pair has."""

    patient: str = "patient"
    observer: str = "physician"
    item: str = "item"
    observers: int = 2
    sheets: tuple[str, str, str] = ("train", "test", "interview")

    @classmethod
    def from_config(cls, config: dict) -> ColumnMap:
        known = {k: v for k, v in config.items() if k in cls.__dataclass_fields__}
        return cls(**(known | ({"sheets": tuple(known["sheets"])} if "sheets" in known else {})))

    def renamed(self, df: DataFrame) -> DataFrame:
        """The frame with canonical column names; a missing key column is an error."""
        require_columns(df, [self.patient, self.observer, self.item])
        return df.withColumnsRenamed({self.patient: "patient", self.observer: "physician", self.item: "item"})


#: Other names under which score files hold their keys.
ALIASES = {"patient_id": ("patient", "context_entity_id", "entity"), "item_text": ("item", "task_instance"), "model": ("model_id", "candidate")}


def with_known_names(df: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """Key columns under their canonical names, and class columns matched without regard to case."""
    lower = {c.lower(): c for c in df.columns}
    renames = {}
    for name, others in ALIASES.items():
        if name not in df.columns and (have := next((lower[o] for o in others if o in lower), None)):
            renames[have] = name
    for c in classes:
        if c not in df.columns and c.lower() in lower:
            renames[lower[c.lower()]] = c
    return df.withColumnsRenamed(renames)


@dataclass(frozen=True)
class FoldScheme:
    """leave_one_out or group_kfold with its number of folds and seed."""

    kind: str = "leave_one_out"
    k: int = 5
    seed: int = 42

    def __post_init__(self) -> None:
        if self.kind not in ("leave_one_out", "group_kfold"):
            raise ValueError(f"unknown fold scheme {self.kind!r}")
        if self.kind == "group_kfold" and self.k < 2:
            raise ValueError("group_kfold needs two folds at least")

    def folds(self, rows: DataFrame, entity: str) -> DataFrame:
        from tidewright.operators import cv

        return cv.leave_one_out(rows, entity) if self.kind == "leave_one_out" else cv.hash_folds(rows, entity, self.k, self.seed)


#: Endpoints by name.
ENDPOINTS = {"context_sensitivity": context_sensitivity, "directional_alignment": directional_alignment, "class_correspondence": class_correspondence, "context_specificity": context_specificity}


def endpoint(name: str):
    if name not in ENDPOINTS:
        raise KeyError(f"unknown endpoint {name!r}; known: {sorted(ENDPOINTS)}")
    return ENDPOINTS[name]


class RatingSource(Protocol):
    """Anything that gives the rating rows of a sheet."""

    def ratings(self, sheet: str) -> DataFrame: ...


class ContextSource(Protocol):
    """Anything that gives (patient_id, fields)."""

    def contexts(self) -> DataFrame: ...


@dataclass
class Registry:
    """Named factories of sources."""

    factories: dict = field(default_factory=dict)

    def add(self, name: str, factory) -> None:
        self.factories[name] = factory

    def get(self, name: str):
        if name not in self.factories:
            raise KeyError(f"unknown source {name!r}; known: {sorted(self.factories)}")
        return self.factories[name]


def numbers_or_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as floats, what is no number as 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).try_cast("float"), F.lit(0.0).cast("float")), F.lit(0.0).cast("float")) for c in columns})
