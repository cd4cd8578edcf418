"""The profile registry, detection and projection by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrecord.profiles.agents import AGENT_EVENTS
from loomrecord.profiles.base import Profile
from loomrecord.profiles.engineering import ENGINEERING
from loomrecord.profiles.logs import APP_LOG, project_generic
from loomrecord.profiles.telemetry import TELEMETRY
from loomrecord.profiles.transcripts import EXEC, HISTORY, PI, ROLLOUT, SESSION_INDEX, TRACE, TRANSCRIPT
from loomrecord.profiles.wires import SESSION_WIRE

PROFILES: dict[str, Profile] = {}
THRESHOLD, TOO_CLOSE = 0.65, 0.08


def register_profile(profile: Profile) -> None:
    """Add a profile; ids are unique."""
    if profile.id in PROFILES or profile.id == "generic":
        raise ValueError(f"profile {profile.id} is already registered")
    PROFILES[profile.id] = profile


for _p in (ROLLOUT, EXEC, TRACE, HISTORY, SESSION_INDEX, TRANSCRIPT, PI, SESSION_WIRE, AGENT_EVENTS, ENGINEERING, TELEMETRY, APP_LOG):
    register_profile(_p)


def detection_scores(records: DataFrame) -> DataFrame:
    """(source_id, profile_id, score, eligible) of every profile over the given records.

    Each profile is one projection and one aggregate to a row per source.
    """
    def one(p: Profile) -> DataFrame:
        signals, varied = p.signals(), p.varied()
        hits = (p.screen or p.prepare)(records).groupBy("source_id").agg(
            F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(k) for k, c in signals.items()], *[(F.min(c) < F.max(c)).alias(k) for k, c in varied.items()])
        score, met = p.score({k: F.col(k) for k in [*signals, *varied]}, F.col("_n"))
        return hits.select("source_id", F.lit(p.id).alias("profile_id"), F.round(score, 6).alias("score"), F.coalesce(met, F.lit(False)).alias("met"))
    out = reduce(DataFrame.unionByName, [one(p) for p in PROFILES.values()])
    return out.select("source_id", "profile_id", "score", (F.col("met") & (F.col("score") >= THRESHOLD)).alias("eligible"))


def detect(records: DataFrame) -> DataFrame:
    """The best eligible profile per source; generic when none is, or the best two are too close."""
    w = Window.partitionBy("source_id").orderBy(F.col("eligible").desc(), F.col("score").desc(), "profile_id")
    # A handful of rows per source from here on.
    ranked = detection_scores(records).withColumns({"rn": F.row_number().over(w), "next": F.lead(F.when(F.col("eligible"), F.col("score"))).over(w)})
    best = ranked.filter(F.col("rn") == 1)
    close = F.col("next").isNotNull() & (F.col("score") - F.col("next") < TOO_CLOSE)
    return best.select("source_id", F.when(F.col("eligible") & ~close, F.col("profile_id")).otherwise("generic").alias("profile_id"), close.alias("ambiguous"))


def project(records: DataFrame, profile_id: str, evidence: bool = False) -> DataFrame:
    """Events under a profile; an unknown id falls back to generic."""
    if profile_id not in PROFILES:
        return project_generic(records)
    return PROFILES[profile_id].project(records, evidence=evidence)
