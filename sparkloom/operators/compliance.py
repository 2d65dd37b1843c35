"""Findings of compliance frameworks over audited actions(action, actor, outcome, t seconds): a row each, of counts and flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FRAMEWORKS: dict[str, Callable[..., DataFrame]] = {}


def framework(name: str) -> Callable:
    """Register a framework's findings by name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _FRAMEWORKS[name] = f
        return f

    return add


def findings(name: str, rows: DataFrame, now: float) -> DataFrame:
    if name not in _FRAMEWORKS:
        raise ValueError(f"no framework {name}; there are {', '.join(sorted(_FRAMEWORKS))}")
    return _FRAMEWORKS[name](rows, now)


def _n(action: str, outcome: str | None = None):  # noqa: ANN202
    hit = F.col("action") == action
    return F.count_if(hit if outcome is None else hit & (F.col("outcome") == outcome))


@framework("pci")
def pci(rows: DataFrame, now: float, most_failures: int = 5, rotation_days: int = 90) -> DataFrame:
    """Who touched card data, whether logins to it failed too often, and how long ago keys were changed (null: never)."""
    touched = F.countDistinct(F.when(F.col("action") == "card_access", F.col("actor")))
    failed = _n("card_login", "failure")
    age = F.floor((F.lit(now) - F.max(F.when(F.col("action") == "key_rotation", F.col("t")))) / 86400)
    return rows.agg(touched.alias("actors"), failed.alias("failed_logins"), (failed > most_failures).alias("too_many"), age.alias("rotation_age")).withColumn("rotation_due", F.coalesce(F.col("rotation_age") > rotation_days, F.lit(True)))


@framework("sox")
def sox(rows: DataFrame, now: float) -> DataFrame:
    """Duties that weren't kept apart, and failed logins of administrators; one is enough."""
    mixed, failed = _n("sod_violation"), _n("admin_login", "failure")
    return rows.agg(mixed.alias("mixed_duties"), failed.alias("failed_admin_logins"), ((mixed > 0) | (failed > 0)).alias("finding"))


@framework("hipaa")
def hipaa(rows: DataFrame, now: float, most_failures: int = 5) -> DataFrame:
    """Denied looks at health data and breaches, of which one is enough, and failed logins, of which some are noise."""
    denied, breaches, failed = _n("phi_access", "denied"), _n("breach_event"), F.count_if(F.col("action").endswith("login") & (F.col("outcome") == "failure"))
    return rows.agg(denied.alias("denied_access"), breaches.alias("breaches"), failed.alias("failed_logins"), ((denied > 0) | (breaches > 0) | (failed > most_failures)).alias("finding"))


@framework("gdpr")
def gdpr(rows: DataFrame, now: float, days: int = 30) -> DataFrame:
    """Requests of persons, those that are older than the days within which they are to be answered, and breaches that were and
    weren't notified."""
    asked, overdue = _n("dsr_request"), F.count_if((F.col("action") == "dsr_request") & (F.col("outcome") != "success") & (F.lit(now) - F.col("t") > days * 86400))
    told, breaches = _n("breach_notification"), _n("breach_event")
    return rows.agg(asked.alias("requests"), overdue.alias("overdue"), told.alias("notified"), F.greatest(breaches - told, F.lit(0)).alias("not_notified"))
