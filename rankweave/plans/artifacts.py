"""Fitted signals at rest.

``model=<signal>/attempt=<n>/tables/<name>`` and ``.../models/<name>``, plus an entry ``log/<signal>-<version>.json``
published last, at most once per version.  Loading takes the newest entry of each signal; an attempt without an
entry does not exist.  Of several savers each keeps its version, the last one is loaded.  Only the newest ``RETAINED``
versions of a signal are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import SparkSession

from rankweave.operators.numbering import remove
from rankweave.plans.heuristics import Heuristics
from rankweave.plans.recommend import Fitted, fit_all
from rankweave.plans.signals import SIGNALS, Artifacts, Features, Signal
from rankweave.sources.commits import Entries, unique

MODEL_CLASSES: dict[str, Any] = {"als": ALSModel, "kmeans": KMeansModel}

RETAINED = 8


def _versions(log: Entries) -> dict[str, list[int]]:
    """Versions of every signal in ascending order, from the names of the entries."""
    found: dict[str, list[int]] = {}
    for name in log.names():
        signal, version = name.rsplit("-", 1)
        found.setdefault(signal, []).append(int(version))
    return found


def _entry(signal: str, version: int) -> str:
    return f"{signal}-{version:09d}"


def save(spark: SparkSession, artifacts: Mapping[str, Artifacts], root: str) -> None:
    """Write a new version of every given signal."""
    log = Entries(spark, f"{root}/log")
    for signal, art in artifacts.items():
        attempt = unique()
        base = f"{root}/model={signal}/attempt={attempt}"
        for name, table in art.tables.items():
            table.write.mode("overwrite").parquet(f"{base}/tables/{name}")
        for name, model in art.models.items():
            model.write().overwrite().save(f"{base}/models/{name}")
        entry = {"signal": signal, "attempt": attempt, "settings": dict(art.settings), "tables": list(art.tables), "models": list(art.models)}
        known = _versions(log).get(signal, [])
        version = known[-1] + 1 if known else 0
        while not log.publish(_entry(signal, version), entry | {"version": version}):
            version += 1
        for old in [v for v in known if v <= version - RETAINED]:
            past = log.read(_entry(signal, old))
            if past:
                remove(spark, f"{root}/model={signal}/attempt={past['attempt']}")
            log.remove(_entry(signal, old))


def load(spark: SparkSession, root: str, only: Iterable[str] | None = None) -> dict[str, Artifacts]:
    """Newest version of every saved signal; an empty dictionary when nothing was saved."""
    wanted = None if only is None else set(only)
    log, out = Entries(spark, f"{root}/log"), {}
    for signal, versions in _versions(log).items():
        if wanted is not None and signal not in wanted:
            continue
        row = log.read(_entry(signal, versions[-1]))
        if row is None:
            raise FileNotFoundError(f"{signal} version {versions[-1]} at {root} was replaced while it was read")
        base = f"{root}/model={signal}/attempt={row['attempt']}"
        out[signal] = Artifacts(
            {n: spark.read.parquet(f"{base}/tables/{n}") for n in row["tables"]},
            {n: MODEL_CLASSES[n].load(f"{base}/models/{n}") for n in row["models"]},
            row["settings"],
        )
    return out


def fit_saved(
    features: Features,
    heuristics: Heuristics,
    root: str,
    force: bool = False,
    signals: Mapping[str, Signal] = SIGNALS,
) -> Fitted:
    """Load what is saved, learn the rest (everything with ``force``), save what was learned.

    The result reads from the saved tables, so later rankings do not repeat the learning.
    """
    spark = features.items.sparkSession
    known = {} if force else load(spark, root, heuristics.mixture)

    def settle(name: str, fresh: Artifacts) -> Artifacts:
        save(spark, {name: fresh}, root)
        return load(spark, root, [name])[name]

    return fit_all(features, heuristics, signals, known, settle=settle)
