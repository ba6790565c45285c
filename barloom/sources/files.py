"""Files around the tables: listings, sidecars, manifests and snapshots, resumable and appending sinks, policies and settings.

Paths go through Hadoop's file systems, so local folders and object stores are alike. What runs on the driver here is one call for a
folder or a small settings file, never rows of a table.
"""

from __future__ import annotations

import ast
import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.csv"
#: Defaults of the labelling settings.
LABELING_DEFAULTS = {
    "use_ohlc": True, "allow_same_bar_touch": True, "same_bar_resolution": "drop", "horizon": {"type": "clock", "minutes": 240}, "max_holding_bars": 5000,
    "atr_kind": "wilder", "atr_period": 14, "exclusive_events": False, "min_gap_bars": 0,
}


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced if it is there."""
    p, fs = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def children(spark: SparkSession, folder: str) -> list[str]:
    """The paths of what a folder holds; none where it is not there."""
    p, fs = _at(spark, folder)
    return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, of the first data file if it is a folder; nothing else of it is read."""
    p, fs = _at(spark, path)
    if fs.getFileStatus(p).isDirectory():
        inside = sorted(c for c in children(spark, path) if c.rsplit("/", 1)[-1][0] not in "._")
        return first_line(spark, inside[0]) if inside else ""
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The file of a pattern that was changed last, the larger of equals; None where there is none."""
    p, fs = _at(spark, pattern)
    found = [(s.getModificationTime(), s.getLen(), s.getPath().toString()) for s in (fs.globStatus(p) or []) if s.isFile()]
    return max(found)[2] if found else None


def tick_source(spark: SparkSession, root: str, symbol: str, month: str, ticks_only: bool = False) -> str | None:
    """The first there is of <root>/<symbol>-ticks-<month>.parquet, .csv and, unless ticks_only, the same with -1m-."""
    kinds = ("ticks",) if ticks_only else ("ticks", "1m")
    options = [f"{root}/{symbol}-{kind}-{month}.{end}" for kind in kinds for end in ("parquet", "csv")]
    return next((o for o in options if exists(spark, o)), None)


def preview(df: DataFrame, rows: int = 5) -> dict:
    """{rows, columns, head} of a table; only the head comes to the driver."""
    return {"rows": df.count(), "columns": df.columns, "head": [r.asDict() for r in df.limit(rows).collect()]}


# --- sinks ------------------------------------------------------------------------------------------


def write_labels(labels: DataFrame, path: str, config: dict, created: str) -> dict:
    """Write labels (label, reason) as Parquet with `<path>.meta.json` beside it: n_rows, n_dropped, label_counts, config, created_utc."""
    labels.write.mode("overwrite").parquet(path)
    spark = labels.sparkSession
    counts = spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "dropped").alias("d")).collect()  # a row for each label
    meta = {"n_rows": sum(r.n for r in counts), "n_dropped": sum(r.d for r in counts), "label_counts": {str(r.label): r.n for r in sorted(counts, key=lambda r: str(r.label))}, "config": config, "created_utc": created}
    write_text(spark, f"{path.rstrip('/')}.meta.json", json.dumps(meta, indent=2))
    return meta


def write_splits(folds: DataFrame, labels: DataFrame, path: str) -> None:
    """(us, label) of each fold's rows, partitioned by fold and split."""
    rows = folds.join(labels.select("eid", "us", "label"), "eid")
    rows.select("us", "label", "fold", "split").write.mode("overwrite").partitionBy("fold", "split").parquet(path)


def append_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").parquet(path)


def resumed(rows: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "month")) -> DataFrame:
    """The rows whose keys have no partition in the table at path yet; all of them if there is no table."""
    spark = rows.sparkSession
    if not exists(spark, path):
        return rows
    done = spark.read.parquet(path).select(*keys).distinct()  # partition columns: read from the listing
    return rows.join(done, list(keys), "left_anti")


def write_chunks(rows: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "month")) -> None:
    """Add rows to a table partitioned by keys; partitions that are there stay as they are, so that a run may be ended and begun again."""
    resumed(rows, path, keys).write.mode("append").partitionBy(*keys).parquet(path)


# --- manifests and snapshots ------------------------------------------------------------------------


def run_tags(spark: SparkSession, root: str) -> list[str]:
    """The folders under root that have a manifest."""
    p, fs = _at(spark, f"{root.rstrip('/')}/*/{MANIFEST}")
    return sorted(s.getPath().getParent().getName() for s in (fs.globStatus(p) or []))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(relpath) of every file under root, read by Spark's own file source without looking at contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    p, fs = _at(spark, root)
    base = fs.resolvePath(p).toString().rstrip("/") + "/"
    return files.select(F.expr(f"substr(path, {len(base) + 1})").alias("relpath"))


def existing(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of a manifest whose relpath is a file."""
    return manifest.join(files.select("relpath").distinct(), "relpath", "left_semi")


def snapshot(spark: SparkSession, root: str, include: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counts by run tag) of the manifests of the given run tags, or of all: with `fullpath`, and only rows whose file exists."""
    tags = [t for t in sorted(include or run_tags(spark, root)) if exists(spark, f"{root}/{t}/{MANIFEST}")]
    if not tags:
        raise ValueError(f"no {MANIFEST} under {root}")
    parts = [spark.read.csv(f"{root}/{t}/{MANIFEST}", header=True).withColumn("run_tag", F.lit(t)) for t in tags]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    rows = existing(union, listing(spark, root)).withColumn("fullpath", F.concat(F.lit(root.rstrip("/") + "/"), "relpath"))
    counts = spark.createDataFrame([(t,) for t in tags], "run_tag string").join(rows.groupBy("run_tag").agg(F.count("*").alias("n")), "run_tag", "left").fillna(0)
    return rows.drop("run_tag"), counts


def examples(snapshot_rows: DataFrame, images: DataFrame, label: str = "label") -> DataFrame:
    """Snapshot rows with their images, by symbol and start; without a label column the label is 0, without a weight the uniqueness 1."""
    have = snapshot_rows.columns
    rows = snapshot_rows.withColumn("y", F.coalesce(F.col(label).cast("long"), F.lit(0).cast("long")) if label in have else F.lit(0).cast("long"))
    rows = rows.withColumn("w", F.coalesce(F.col("uniqueness").cast("double"), F.lit(1.0)) if "uniqueness" in have else F.lit(1.0))
    return rows.join(images, ["symbol", "start"])


# --- settings ---------------------------------------------------------------------------------------


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """(key, tp_mult, sl_mult) of a JSON file {key: {"tp_mult": .., "sl_mult": ..}}; an absent multiple is null."""
    found = json.loads(read_text(spark, path))
    number = lambda x: None if x is None else float(x)
    return spark.createDataFrame([(str(k), number(v.get("tp_mult")), number(v.get("sl_mult"))) for k, v in found.items() if v], "key string, tp_mult double, sl_mult double")


def read_regimes(spark: SparkSession, path: str) -> DataFrame:
    """(month, regime) of a JSON file {month: regime}."""
    return spark.createDataFrame([(str(k), str(v)) for k, v in json.loads(read_text(spark, path)).items()], "month string, regime string")


def read_settings(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file of settings."""
    import yaml

    return yaml.safe_load(read_text(spark, path)) or {}


def class_weights(text: str | None, n_classes: int | None = None) -> dict[int, float] | None:
    """Weights of classes written as JSON, as a literal, or as 0:1.0,1:2.5; None where there are none or they can't be read."""
    if not text or not text.strip():
        return None
    loose = lambda t: dict(pair.split(":") for pair in t.strip().strip("{}").split(",") if pair)
    for read in (json.loads, ast.literal_eval, loose):
        try:
            out = {int(str(k).strip().strip("\"'")): float(v) for k, v in read(text).items()}
        except (ValueError, SyntaxError, AttributeError, TypeError):
            continue
        if n_classes is not None and not set(range(n_classes)) <= set(out):
            warnings.warn(f"class weights lack some of 0..{n_classes - 1}: {sorted(out)}", stacklevel=2)
        return out or None
    warnings.warn(f"class weights can't be read: {text}", stacklevel=2)
    return None


def labeling_settings(given: dict | None) -> dict:
    """Labelling settings with their defaults; raises where the barriers' keys do not fit their mode."""
    if given is None:
        raise ValueError("labeling config missing")
    barriers = dict(given.get("barriers", {}))
    mode = str(barriers.get("mode", "percent")).lower()
    own = {"atr": ("pt_mult", "sl_mult"), "percent": ("up", "down")}
    if mode not in own:
        raise ValueError(f"barriers.mode must be 'atr' or 'percent', got {mode}")
    other = own["percent" if mode == "atr" else "atr"]
    if any(k in barriers for k in other):
        raise ValueError(f"barriers.mode='{mode}' forbids {other[0]} and {other[1]}")
    if not all(k in barriers for k in own[mode]):
        raise ValueError(f"barriers.mode='{mode}' requires {own[mode][0]} and {own[mode][1]}")
    return LABELING_DEFAULTS | dict(given) | {"normalize_by_close": mode == "percent"}
