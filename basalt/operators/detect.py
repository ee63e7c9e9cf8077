"""Detector contract, registry and runner.

A detector is a function over fact tables (a dict of DataFrames) that returns findings in one shape. It declares
the tables and edge kinds that it needs; the runner gates on what is there and reports coverage.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import finding_id
from ..functions.session import written
from .ranking import TIER

Facts = dict[str, DataFrame]
FINDING = "detector_id string, variant string, file string, symbol string, start_line int, end_line int, severity double, measures map<string,double>"


@dataclass(frozen=True)
class Detector:
    id: str
    layer: str
    tier: str | None
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    thresholds: dict[str, float] = field(default_factory=dict)
    cap: int | None = None
    registered: bool = True
    edge_kinds: tuple[str, ...] = ()
    #: Edge kinds that it reads, for ``kept_findings``; none: all.
    reads: tuple[str, ...] = ()


REGISTRY: dict[str, Detector] = {}


def detector(id: str, layer: str, tier: str | None, needs: tuple[str, ...], cap: int | None = None, registered: bool = True, edge_kinds: tuple[str, ...] = (), **thresholds: float):
    """Registers a function (facts, thresholds) -> findings."""

    def add(run):
        REGISTRY[id] = Detector(id, layer, tier, needs, run, thresholds, cap, registered, edge_kinds)
        return run

    return add


def register(extra: Detector) -> Callable[[], None]:
    """Adds a detector at run time; the returned function removes it."""
    REGISTRY[extra.id] = extra
    return lambda: REGISTRY.pop(extra.id, None) and None


def findings(df: DataFrame, id: str, severity: Column | float, file: Column | str = "file", symbol: Column | str | None = None, start: Column | str | None = None, end: Column | str | None = None, variant: Column | str | None = None, **measures: Column | str) -> DataFrame:
    """Projects rows to the shape of findings. ``variant`` as a string is a literal."""
    col = lambda c, t: F.lit(None).cast(t) if c is None else (F.col(c) if isinstance(c, str) else c).cast(t)
    sev = F.least(F.lit(100.0), (severity if isinstance(severity, Column) else F.lit(severity)).cast("double"))
    parts = [x for k, v in measures.items() for x in (F.lit(k), col(v, "double"))]
    return df.select(F.lit(id).alias("detector_id"), (F.lit(variant) if isinstance(variant, str) or variant is None else variant).cast("string").alias("variant"), col(file, "string").alias("file"), col(symbol, "string").alias("symbol"), col(start, "int").alias("start_line"), col(end, "int").alias("end_line"), sev.alias("severity"), (F.create_map(*parts) if parts else F.create_map().cast("map<string,double>")).alias("measures"))


def with_ids(found: DataFrame) -> DataFrame:
    """Adds the stable id and the impact tier's value."""
    place = F.array(F.concat_ws("#", F.coalesce("file", F.lit("")), F.coalesce("symbol", F.lit(""))))
    tier = F.lit(None).cast("double")
    for d in REGISTRY.values():
        if d.tier:
            tier = F.when(F.col("detector_id") == d.id, F.lit(TIER[d.tier])).otherwise(tier)
    return found.withColumns({"id": finding_id(F.col("detector_id"), F.col("variant"), place), "kind": F.col("detector_id"), "impact": tier})


def fingerprints(facts: Facts) -> dict[str, str]:
    """A hash of the rows of every fact table, whatever their order; of edges one to a kind (``edges:kind``). One aggregation to a table."""
    out = {}
    for name, df in facts.items():
        row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
        sums = (F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x"))
        if name == "edges":
            out |= {f"edges:{r.kind}": f"{r.n}:{r.s}:{r.x}" for r in df.groupBy("kind").agg(*sums).collect()}  # a row for each kind
        else:
            r = df.agg(*sums).first()
            out[name] = f"{r.n}:{r.s}:{r.x}"
    return out


class _Noting(dict):
    """Facts that note which tables were asked for, whether there or not."""

    def __init__(self, facts: Facts):
        super().__init__(facts)
        self.asked: set[str] = set()

    def __getitem__(self, name):
        self.asked.add(name)
        return super().__getitem__(name)

    def __contains__(self, name):
        self.asked.add(name)
        return super().__contains__(name)

    def get(self, name, default=None):
        self.asked.add(name)
        return super().get(name, default)


def kept_findings(spark: SparkSession, facts: Facts, path: str, version: str) -> Callable[[Detector, dict[str, float], Callable[[Facts], DataFrame]], DataFrame]:
    """For ``run_detectors(keep=...)``: what a detector found before, where the part of the facts that it reads has not changed.

    Findings are stored below the path by detector and by a hash of the version, its thresholds and the fingerprints of the tables that it asked
    for when it last ran (noted beside them); of edges those of the kinds that it declares to read, else of all. A table that was not
    written to its end does not count.
    """
    prints = fingerprints(facts)

    def keep(d: Detector, thresholds: dict[str, float], run: Callable[[Facts], DataFrame]) -> DataFrame:
        place = f"{path}/{d.id}/{hashlib.sha1(version.encode()).hexdigest()}"

        def at(asked: list[str]) -> str:
            parts = [(t, prints.get(t)) for t in asked if t != "edges"]
            if "edges" in asked:
                parts += sorted((k, v) for k, v in prints.items() if k.startswith("edges:") and (not d.reads or k[6:] in d.reads))
            return f"{place}/{hashlib.sha1(json.dumps([sorted(thresholds.items()), parts]).encode()).hexdigest()}"

        if written(spark, f"{place}/asked"):
            known = at(sorted(r.table for r in spark.read.schema("table string").parquet(f"{place}/asked").collect()))  # names of tables
            if written(spark, known):
                return spark.read.schema(FINDING).parquet(known)
        noting = _Noting(facts)
        found = run(noting)
        asked = sorted(noting.asked)
        found.write.mode("overwrite").parquet(at(asked))
        spark.createDataFrame([(t,) for t in asked], "table string").coalesce(1).write.mode("overwrite").parquet(f"{place}/asked")
        return spark.read.schema(FINDING).parquet(at(asked))

    return keep


def run_detectors(spark: SparkSession, facts: Facts, only: tuple[str, ...] | None = None, extra: bool = False, thresholds: dict[str, dict[str, float]] | None = None, keep: Callable[[Detector, dict[str, float], Callable[[Facts], DataFrame]], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings with ids, coverage). The gates look at table names and at the distinct edge kinds, a handful of values. ``keep``: see ``kept_findings``."""
    from .ranking import capped

    chosen = [d for d in REGISTRY.values() if not (only and d.id not in only) and (d.registered or extra or only)]
    kinds = {r[0] for r in facts["edges"].select("kind").distinct().collect()} if "edges" in facts and any(d.edge_kinds for d in chosen) else set()
    out, cover = None, []
    for d in chosen:
        missing = [t for t in d.needs if t not in facts]
        lost = [k for k in d.edge_kinds if k not in kinds]
        if missing or lost:
            cover.append((d.id, "no-aplicable" if missing else "sin-aristas", missing + lost))
            continue
        cover.append((d.id, "corrio", []))
        limits = d.thresholds | (thresholds or {}).get(d.id, {})

        def run(facts: Facts, d=d, limits=limits) -> DataFrame:
            f = d.run(facts, limits)
            return f if d.cap is None else capped(f.withColumn("id", F.concat_ws("#", "file", "symbol", "variant")), d.cap).drop("id")

        f = keep(d, limits, run) if keep else run(facts)
        out = f if out is None else out.unionByName(f)
    if out is None:
        out = spark.createDataFrame([], FINDING)
    return with_ids(out), spark.createDataFrame(cover, "detector_id string, status string, missing array<string>")
