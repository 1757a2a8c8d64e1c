"""From feature tables to rankings for a table of users."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rankweave.functions.scaling import MINMAX
from rankweave.operators.filters import candidates as all_candidates
from rankweave.operators.filters import seen_items
from rankweave.operators.numbering import durable
from rankweave.plans.combine import combine
from rankweave.plans.heuristics import Heuristics
from rankweave.plans.scores import DenseScores, Scores
from rankweave.plans.signals import SIGNALS, Artifacts, Features, Signal
from rankweave.schema import ITEM_ID, USER_ID

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Fitted:
    """Artifacts per signal, and why the others are missing."""

    artifacts: Mapping[str, Artifacts]
    skipped: Mapping[str, str]


def fit_all(
    features: Features,
    heuristics: Heuristics,
    signals: Mapping[str, Signal] = SIGNALS,
    known: Mapping[str, Artifacts] | None = None,
    force: bool = False,
    settle: Callable[[str, Artifacts], Artifacts] = lambda name, fresh: fresh.kept(),
    strict: bool = False,
) -> Fitted:
    """Learn every active signal that is not in ``known`` (all of them with ``force``).

    ``settle`` writes what was learned and returns what to read later; by default it goes to the shared
    folder.  It runs per signal, so that a plan that fails late costs its own signal only.

    A signal that cannot be learned, for example factors of an empty table, is skipped and reported in
    ``skipped``; the others still serve.  With ``strict`` it is an error: for callers that hand on a ranking
    only, in which a missing signal would not show.  A name that is no signal is always an error.
    """
    artifacts: dict[str, Artifacts] = {}
    skipped: dict[str, str] = {}
    unknown = sorted(set(heuristics.mixture) - set(signals))
    if unknown:
        raise ValueError(f"unknown signals: {', '.join(unknown)}")
    for name in heuristics.mixture:
        if not force and known and name in known:
            artifacts[name] = known[name]
            continue
        try:
            fresh = signals[name].fit(features, heuristics.signals[name].fit_params())
            artifacts[name] = settle(name, fresh)
        except Exception as problem:  # noqa: BLE001 - one broken signal must not stop the others
            if strict:
                raise
            skipped[name] = f"{type(problem).__name__}: {problem}"
            log.warning("signal %s skipped: %s", name, skipped[name])
    return Fitted(artifacts, skipped)


def score_all(
    fitted: Fitted,
    users: DataFrame,
    candidates: DataFrame,
    method: str = MINMAX,
    signals: Mapping[str, Signal] = SIGNALS,
) -> list[Scores | DenseScores]:
    return [
        signals[name].score(art, users, candidates, method) for name, art in fitted.artifacts.items()
    ]


def recommend(
    features: Features,
    users: DataFrame,
    heuristics: Heuristics,
    fitted: Fitted | None = None,
    signals: Mapping[str, Signal] = SIGNALS,
) -> DataFrame:
    """Top-k items with breakdown for every row of ``users(user_id)``.

    Unknown users are ranked by the signals that do not depend on the user.  Without ``fitted`` every signal is
    learned here, and one that cannot be learned is an error.
    """
    fitted = fit_all(features, heuristics, signals, strict=True) if fitted is None else fitted
    # Every signal joins the candidates.
    pool = durable(all_candidates(features.items), "candidates")
    scores = score_all(fitted, users, pool, heuristics.normalization, signals)
    seen = None
    if heuristics.filters.exclude_seen:
        seen = features.interactions.select(USER_ID, ITEM_ID)
        if any(isinstance(s, DenseScores) for s in scores):
            # Read several times below.
            seen = durable(seen_items(features.interactions, users), "seen")
    return combine(
        users,
        pool,
        scores,
        heuristics.mixture,
        heuristics.filters,
        heuristics.top_k,
        seen,
        features.items,
    )
