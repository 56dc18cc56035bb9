"""Guards on names and schemas: they look at columns and parameters, never at rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, needed: Iterable[str], name: str = "table") -> DataFrame:
    """df, if it has all the columns."""
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def without_leakage(df: DataFrame, forbidden: Iterable[str], name: str = "features") -> DataFrame:
    """df, if none of its columns is one that tells the outcome."""
    if found := sorted(set(forbidden) & set(df.columns)):
        raise ValueError(f"{name} holds columns of the outcome: {', '.join(found)}")
    return df


def feature_union(*names: Iterable[str], forbidden: Iterable[str] = ()) -> list[str]:
    """All names once, in the order in which they come first; a forbidden one fails."""
    out = list(dict.fromkeys(n for group in names for n in group))
    if found := sorted(set(forbidden) & set(out)):
        raise ValueError(f"forbidden features: {', '.join(found)}")
    return out


def checked_bundle(bundle: Mapping, horizon_days: int, columns: Iterable[str]) -> Mapping:
    """The parameters of a fitted model, if they can score a table with these columns."""
    if missing := sorted({"horizon_days", "features", "action", "warning"} - set(bundle)):
        raise ValueError(f"model lacks {', '.join(missing)}")
    if bundle["horizon_days"] != horizon_days:
        raise ValueError(f"model of {bundle['horizon_days']} days, {horizon_days} asked")
    if absent := sorted(set(bundle["features"]) - set(columns)):
        raise ValueError(f"features not in the table: {', '.join(absent)}")
    if not 0 < bundle["warning"] <= bundle["action"] <= 1:
        raise ValueError("thresholds must be 0 < warning <= action <= 1")
    return bundle


def chosen(name: str, allowed: Iterable[str]) -> str:
    """name, if it is one of those allowed: for columns that a caller picks."""
    allowed = list(allowed)
    if name not in allowed:
        raise ValueError(f"{name!r} is none of {', '.join(allowed)}")
    return name


def first_present(registry: Mapping[str, Callable[[], DataFrame]], *names: str) -> DataFrame:
    """The first of the named tables that the registry has: the preferred one before the one to fall back on."""
    for name in names:
        if name in registry:
            return registry[name]()
    raise ValueError(f"none of {', '.join(names)} is registered")
