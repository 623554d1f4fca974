"""Readers and sinks: Parquet tables, sheets, context records, score files, bundles and manifests."""

from __future__ import annotations

import hashlib
import json
import zipfile
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import trimmed

CLASSES = ["behavioral_health", "diagnoses", "disabilities", "infectious_diseases", "genetics", "medications", "sexual_reproductive_health", "social_determinants_of_health", "violence", "other"]
CONDITIONS = ["context_free", "correct_context", "shuffled_context"]
CONTEXT_FIELDS = ["summary", "medical_history", "allergies", "medication_history", "social_history", "labs", "radiology", "procedures"]


class SheetNotFoundError(KeyError):
    """A requested sheet isn't there; the message lists the ones that are."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of this name in a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def patient_number(column: str) -> Column:
    return F.regexp_extract(column, "([0-9]+)", 1)


def study_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """The rating rows with the patient's number and the trimmed item as keys."""
    ratings = table(spark, folder, "ratings")
    return ratings.withColumns({"patient": patient_number("patient"), "item": trimmed(F.col("item"))})


def load_sheets(spark: SparkSession, folder: str, sheets: list[str], casts: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """One DataFrame per named sheet, each a Parquet folder or a CSV file of the folder.

    An empty list is an error, as is a missing sheet.
    """
    if not sheets:
        raise ValueError("no sheet is named")
    there = {p.stem: p for p in Path(folder).iterdir() if p.suffix in (".parquet", ".csv")}
    if missing := [s for s in sheets if s not in there]:
        raise SheetNotFoundError(f"sheets {missing} not found; there are {sorted(there)}")
    read = lambda p: spark.read.parquet(str(p)) if p.suffix == ".parquet" else spark.read.option("header", True).csv(str(p))
    out = {s: read(there[s]) for s in sheets}
    return {s: df.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items() if c in df.columns}) for s, df in out.items()}


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def load_context_records(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, fields map<string, array<string>>) of a JSON object keyed by patient; a single text becomes a list of one."""
    text = spark.read.text(path, wholetext=True)
    records = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("patient_id", "raw"))
    as_list = lambda _, v: F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")).otherwise(F.array(v))
    out = records.select("patient_id", F.transform_values("raw", as_list).alias("fields"))
    if out.isEmpty():
        raise ValueError("no context record")
    return out


def normalise_model(df: DataFrame) -> DataFrame:
    """model from model, else model_id, else the word unknown."""
    have = [F.col(c) for c in ("model", "model_id") if c in df.columns]
    return df.withColumn("model", F.coalesce(*have, F.lit("unknown"))).drop("model_id")


def load_scores(spark: SparkSession, by_condition: dict[str, str] | None = None, long_path: str | None = None, classes: list[str] = CLASSES) -> DataFrame:
    """Scores from one long CSV with a condition column or from one CSV per condition; the long one wins when both are given."""
    casts = {c: F.expr(f"try_cast(`{c}` as double)") for c in classes}
    read = lambda p: normalise_model(spark.read.option("header", True).csv(p))
    if long_path:
        return require_columns(read(long_path), ["condition"]).withColumns(casts)
    if not by_condition or (missing := [c for c in CONDITIONS if c not in by_condition]):
        raise ValueError(f"score files are missing: {missing if by_condition else CONDITIONS}")
    parts = [read(by_condition[c]).withColumns(casts).withColumn("condition", F.lit(c)) for c in CONDITIONS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def model_slug(model: str) -> str:
    return model.replace("/", "__")


def load_scores_dir(spark: SparkSession, root: str, classes: list[str] = CLASSES) -> DataFrame:
    """All models below a folder, one subfolder per model slug; those that lack a condition and those beginning with _ are left out."""
    parts = []
    for sub in sorted(p for p in Path(root).iterdir() if p.is_dir() and not p.name.startswith("_")):
        files = {c: str(sub / f"{c}.csv") for c in CONDITIONS if (sub / f"{c}.csv").exists()}
        if len(files) == len(CONDITIONS):
            parts.append(load_scores(spark, files, classes=classes).withColumn("model", F.lit(sub.name.replace("__", "/", 1))))
    if not parts:
        raise ValueError(f"no complete model below {root}")
    return reduce(DataFrame.unionByName, parts)


def write_scores(scores: DataFrame, folder: str, condition_col: str = "score_condition") -> None:
    """One CSV folder per condition, sorted by patient and item inside each file."""
    for condition in CONDITIONS:
        scores.where(F.col(condition_col) == condition).sortWithinPartitions("patient_id", "item_text").write.mode("overwrite").option("header", True).csv(f"{folder}/{condition}")


def write_bundle(folder: str, target: str) -> list[str]:
    """A zip of the CSV and Markdown files of a driver folder; returns the names."""
    names = sorted(p for p in Path(folder).rglob("*") if p.suffix in (".csv", ".md"))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in names:
            archive.write(path, path.relative_to(folder))
    return [str(p.relative_to(folder)) for p in names]


def run_manifest(config: dict, inputs: list[str]) -> dict:
    """The configuration, its digest, and the digests of the input files (or of a folder's files)."""
    digest = lambda p: hashlib.sha256(Path(p).read_bytes()).hexdigest()
    files = [f for p in inputs for f in (sorted(x for x in Path(p).rglob("*") if x.is_file()) if Path(p).is_dir() else [Path(p)])]
    return {
        "config": config,
        "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(),
        "inputs": {str(f): digest(f) for f in files},
        "created_at": datetime.now(timezone.utc).isoformat(),
    }


def synthetic_ratings(spark: SparkSession, n_patients: int = 6, n_items: int = 16, n_observers: int = 2, flip: float = 0.06, seed: int = 7, classes: list[str] = CLASSES) -> DataFrame:
    """Ratings made from hashes alone: a true label per patient, item and class, flipped by each observer with a small chance."""
    share = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_000)) / 1_000_000
    rows = spark.range(n_patients * n_items * n_observers).selectExpr(f"cast(id div {n_items * n_observers} as int) as p", f"cast(id div {n_observers} % {n_items} as int) as i", f"cast(id % {n_observers} as int) + 1 as physician")
    label = lambda c: F.when(share(F.lit(c), "p", "i", "physician") < flip, 1.0 - (share(F.lit(c), "p", "i") < 0.4).cast("double")).otherwise((share(F.lit(c), "p", "i") < 0.4).cast("double"))
    return rows.select(F.format_string("P%03d", F.col("p") + 1).alias("patient"), "physician", F.format_string("item %02d", F.col("i") + 1).alias("item"), *(label(c).alias(c) for c in classes))


def unpivoted(df: DataFrame, ids: list[str], classes: list[str], variable: str = "category", value: str = "score") -> DataFrame:
    """One row per id and class."""
    return df.select(*ids, *(F.col(c).cast("double") for c in classes)).unpivot(ids, classes, variable, value)
