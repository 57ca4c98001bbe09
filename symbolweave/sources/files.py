"""Files as rows: discovery, the filter of generated files, and manifests."""

from __future__ import annotations

import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings and sizes that mark generated or minified files.
GENERATED = [".min.js", ".min.css", ".min.mjs", ".bundle.js", "-bundle.js", ".bundle.css", "-bundle.css", ".map"]
DENSE_BYTES, DENSE_LINES, MINIFIED_LINE, MINIFIED_BYTES, MINIFIED_MEAN, PREFIX = 30_000, 20, 2_000, 50_000, 1_000, 1 << 20


def discover(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """(path, length, modificationTime, content) of files by extension, without hidden folders and files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])
    return files.where(wanted & ~F.substring_index("path", ":", -1).rlike(r"/\.[^/]"))


def generated(files: DataFrame) -> DataFrame:
    """files (path, length, content) with the column generated; Rust files never are. The first MiB decides."""
    text = F.decode(F.substring("content", 1, PREFIX), "ISO-8859-1")
    lines = F.split(text, "\n")
    longest = F.array_max(F.transform(lines, F.length))
    dense = (F.col("length") >= DENSE_BYTES) & (F.size(lines) < DENSE_LINES)
    small = (longest > MINIFIED_LINE) & (F.col("length") >= MINIFIED_BYTES) & (F.length(text) / F.size(lines) >= MINIFIED_MEAN)
    ending = F.lit(False)
    for e in GENERATED:
        ending = ending | F.lower("path").endswith(e)
    return files.withColumn("generated", ~F.col("path").endswith(".rs") & (ending | dense | small))


def _manifest(batches):
    """Dependencies of each Cargo manifest, null package where it does not parse."""
    for b in batches:
        rows = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                t = tomllib.loads((content or b"").decode())
            except (UnicodeDecodeError, tomllib.TOMLDecodeError):
                rows.append((path, None, None, "unreadable", None))
                continue
            shared = t.get("workspace", {}).get("dependencies", {})
            tables = {"normal": t.get("dependencies", {}), "dev": t.get("dev-dependencies", {}), "build": t.get("build-dependencies", {}), "workspace": shared}
            for kind, deps in tables.items():
                for name, spec in deps.items():
                    spec = spec if isinstance(spec, dict) else {"version": spec}
                    if spec.get("workspace") and isinstance(shared.get(name), (dict, str)):
                        spec = {**(shared[name] if isinstance(shared[name], dict) else {"version": shared[name]}), **spec}
                    rows.append((path, t.get("package", {}).get("name"), spec.get("package", name), kind, spec.get("version")))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "package", "dependency", "kind", "version"])


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(path, package, dependency, kind, version) of Cargo manifests in files (path, content)."""
    return files.where(F.col("path").endswith("Cargo.toml")).select("path", "content").mapInArrow(_manifest, "path string, package string, dependency string, kind string, version string")


def stale_files(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (path, stamp) that are new or changed since cached: what has to be extracted again."""
    return current.join(cached.select("path", "stamp"), ["path", "stamp"], "left_anti")
