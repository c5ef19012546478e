"""Closed vocabularies, their ranks, and predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence bands, strongest first; the first six draw an edge.
BANDS = ("precise", "typed", "import-guided", "inheritance-guided", "exact", "scoped", "candidate", "external", "blocked", "unresolved", "contradicted")
DRAWN = BANDS[:6]
# The eleven bands' ranks are their distance from the weakest.
BAND_RANK = {b: len(BANDS) - 1 - i for i, b in enumerate(BANDS)}
# File states, identity strengths, directions, callable kinds.
FILE_STATUS = ("parsed", "partial", "failed", "skipped", "binary", "redacted")
STRENGTHS = ("unresolved", "declared", "exact")
DIRECTIONS = ("provides", "consumes", "both")
CALLABLE_KINDS = ("Function", "Method", "Constructor", "Test")
# Names too common to resolve by name, in any language.
BLOCKED_NAMES = (
    "get set close open run main start stop to_dict from_dict to_json from_json serialize deserialize handle execute process validate parse format update create delete "
    "remove add append clear read write load save send receive setup teardown init reset next value name toString equals hashCode length size isEmpty push pop apply call "
    "bind then catch map filter reduce forEach"
).split()
# The same, in Python only.
BLOCKED_PYTHON = ("__init__", "__str__", "__repr__", "__enter__", "__exit__")
# Path segments that name an architectural role, in the order they are tried.
PATH_ROLES = {
    "api": "controllers controller api rest web handlers routes endpoints".split(),
    "service": "services service application usecases use_cases".split(),
    "domain": "domain model models entities core".split(),
    "persistence": "repository repositories persistence dao db storage migrations".split(),
    "adapter": "adapters adapter clients client gateway gateways infra infrastructure".split(),
    "port": "ports port".split(),
}
# Confidences of the scored resolution strategies.
STRATEGY_SCORES = {"import_map": 0.95, "same_module": 0.90, "qualified_suffix": 0.90, "import_map_suffix": 0.85, "unique_name": 0.75, "suffix_match": 0.55, "fuzzy_single": 0.40, "fuzzy_multi": 0.30}
TYPED_SCORE = 0.85


def band_rank(band: Column) -> Column:
    """10 for the strongest band down to 0; null for anything else."""
    out = F.lit(None).cast("int")
    for b, r in BAND_RANK.items():
        out = F.when(band == b, r).otherwise(out)
    return out


def band_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(b) for b in reversed(BANDS))), rank + 1)


def is_drawn(band: Column) -> Column:
    return F.coalesce(band.isin(*DRAWN), F.lit(False))


def is_blocked(language: Column, name: Column) -> Column:
    return F.coalesce(name.isin(*BLOCKED_NAMES) | ((language == "python") & name.isin(*BLOCKED_PYTHON)), F.lit(False))


def engine_verdict(strategy: Column, score: Column, candidates: Column) -> Column:
    """'typed' for one candidate of the typed resolver with enough confidence; 'hint' for other scored answers; else 'diagnostic'."""
    typed = (strategy == "lsp_typed") & (candidates == 1) & score.between(TYPED_SCORE, 1.0)
    hint = strategy.isNotNull() & score.between(0.0, 1.0) & (candidates >= 1)
    return F.when(typed, "typed").when(hint, "hint").otherwise("diagnostic")


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.45, "medium").when(score >= 0.25, "speculative").otherwise("")


def path_role(path: Column) -> Column:
    """The first role, in order, one of whose segments is a directory of the path."""
    parts = F.split(F.lower(path), "/")
    out = F.lit(None).cast("string")
    for role in reversed(PATH_ROLES):
        out = F.when(F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(x) for x in PATH_ROLES[role]))), role).otherwise(out)
    return out
