"""Data sources from YAML or dicts, the format of each, and what to import anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.sources import feeds, gtfs, reference

OBJECTS = ("operators", "stops", "stop_groups", "services", "journeys", "realtime", "service_alerts", "stops_detailed", "journey_tracks")


@dataclass
class Dataset:
    identifier: str
    format: str
    source: str = ""
    provider: dict = field(default_factory=dict)
    authentication: dict = field(default_factory=dict)
    supported: dict = field(default_factory=dict)
    refresh_s: int = 0


def datasets(sources: list[dict]) -> list[Dataset]:
    """Datasets of sources, named <source>-<dataset>, with the source's provider and login where they have none.

    Without a list of objects a dataset gives all but detailed stops and tracks.
    """
    out = []
    for s in sources:
        for d in s.get("datasets", []):
            given = d.get("supported_objects") or {k: k not in ("stops_detailed", "journey_tracks") for k in OBJECTS}
            out.append(Dataset(f"{s['identifier']}-{d['identifier']}", d["format"], d.get("source", ""), d.get("provider") or s.get("provider", {}), d.get("authentication") or s.get("authentication", {}), {k: bool(given.get(k)) for k in OBJECTS}, d.get("refresh_interval", 0)))
    return out


def load_yaml(paths: list[str]) -> list[dict]:
    import yaml  # only where sources are kept as YAML

    out = []
    for p in paths:
        with open(p) as f:
            out.append(yaml.safe_load(f))
    return out


def _gtfs(spark: SparkSession, d: Dataset, folder: str) -> dict[str, DataFrame]:
    made = {"operators": gtfs.operators, "stops": gtfs.stops, "services": gtfs.services, "journeys": gtfs.journeys}
    return {k: f(spark, folder, d.identifier) for k, f in made.items() if d.supported.get(k)}


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%SZ")


FORMATS: dict[str, Callable[[SparkSession, Dataset, str], dict[str, DataFrame]]] = {
    "gtfs-schedule": _gtfs,
    "gtfs-realtime": lambda spark, d, path: {"realtime": feeds.gtfs_rt(spark.read.text(path), _now()), "service_alerts": feeds.gtfs_rt_alerts(spark.read.text(path))},
    "siri-vm": lambda spark, d, path: {"realtime": feeds.siri_vm(spark, path, _now())},
    "siri-sx": lambda spark, d, path: {"service_alerts": reference.siri_sx(spark, path, d.identifier, _now())},
    "gb-noc": lambda spark, d, path: {"operators": reference.noc_operators(spark, path)},
    "gb-nationalrailtoc": lambda spark, d, path: {"operators": reference.train_companies(spark, path)},
    "gb-naptan": lambda spark, d, path: {"stops": feeds.naptan_stops(spark, path), "stop_groups": feeds.naptan_areas(spark, path)},
    "gb-cif": lambda spark, d, path: {"journeys": feeds.cif_resolved(feeds.cif_schedules(spark, path))},
    "gb-networkrailcorpus": lambda spark, d, path: {"stops": feeds.corpus(spark, path, d.identifier)},
}


def read(spark: SparkSession, d: Dataset, path: str) -> dict[str, DataFrame]:
    if d.format not in FORMATS:
        raise ValueError(f"no importer for format {d.format!r}")
    return FORMATS[d.format](spark, d, path)


def fresh(last_modified_s: int | None, refresh_s: int, now_s: int, forced: bool = False) -> bool:
    """Whether an import may be skipped, as the last one is young enough."""
    return not forced and bool(refresh_s) and last_modified_s is not None and last_modified_s + refresh_s > now_s


def content_hash(spark: SparkSession, path: str) -> str:
    """A digest of all files of a dataset, whatever their number: of the sorted digests of each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = files.select(F.sha2("content", 256).alias("h")).where(F.length("h") > 0)
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256)).first()[0]


def import_dataset(spark: SparkSession, d: Dataset, path: str, versions: str, now_s: int, forced: bool = False) -> tuple[str, dict[str, DataFrame] | None]:
    """Import a dataset if it is due and has changed: ("fresh", "unchanged" or "imported", what was read).

    ``versions`` is a folder with the record of each look (dataset, hash, at_s);
    one that is young enough, or that has the content of the last, is left alone
    unless forced.  Files that are gzip are read as they are.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(versions)
    known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    table = spark.read.schema("dataset string, hash string, at_s long").json(versions).where(F.col("dataset") == d.identifier) if known else None
    last = table.agg(F.max(F.struct("at_s", "hash")).alias("v")).select("v.*").first() if known else None
    at, had = (last.at_s, last.hash) if last else (None, None)
    if fresh(at, d.refresh_s, now_s, forced):
        return "fresh", None
    digest = content_hash(spark, path)
    looked = spark.createDataFrame([(d.identifier, digest, now_s)], "dataset string, hash string, at_s long")
    if digest == had and not forced:
        looked.write.mode("append").json(versions)  # a dataset that was found unchanged is fresh again
        return "unchanged", None
    made = {k: v for k, v in read(spark, d, path).items() if not d.supported or d.supported.get(k)}
    looked.write.mode("append").json(versions)
    return "imported", made
