"""The analysis DAG from the driver tables to every stage table.

``Stages`` builds each stage as a DataFrame and memoises it.  The stages that several
queries read (the grouped web log, the merged and the flagged event tables, the visit
durations) are *stage tables*: with ``materialize=True`` they are written once as Parquet
into the shared folder named by ``spark.checkpoint.dir`` and read back.  That cuts the
lineage (a lost executor recomputes from the stage table, not from the raw logs), keeps
each downstream plan small, lets every KPI read only its columns of the flagged events,
and gives Catalyst the tables' sizes.  ``Stages.shared`` keeps one instance per (session,
input folder, mode), so queries run in one session share the stage tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, durations, sessions, sketches
from ..sources.fixtures import Domain, load_domain
from ..sources.stage import clustered_table, stage_table


class Stages:
    _shared: dict[tuple, "Stages"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, mode: str = "segmented",
                 domain: Domain | None = None, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.mode = mode
        self.materialize = materialize
        self._domain = domain

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str, mode: str = "segmented",
               materialize: bool = True) -> "Stages":
        key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"), mode,
               materialize)
        if key not in cls._shared:
            cls._shared[key] = cls(spark, sf_dir, mode=mode, materialize=materialize)
        return cls._shared[key]

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """A stage table when materialising, else left lazy."""
        return stage_table(df, name) if self.materialize else df

    @cached_property
    def domain(self) -> Domain:
        return self._domain or load_domain(self.spark, self.sf_dir)

    # -- cleaning and joins ------------------------------------------------------------
    @cached_property
    def web_log_clean(self) -> DataFrame:
        return cleaning.web_log_clean(self.domain.web_pt1, self.domain.web_pt2)

    @cached_property
    def web_with_groups(self) -> DataFrame:
        return self.stage(cleaning.web_with_groups(self.web_log_clean, self.domain.experiment),
                          "web-with-groups")

    @cached_property
    def demo_clean(self) -> DataFrame:
        return cleaning.demo_clean(self.domain.demographics)

    @cached_property
    def master(self) -> DataFrame:
        return cleaning.master(self.demo_clean, self.web_with_groups)

    @cached_property
    def merged_events(self) -> DataFrame:
        return self.stage(cleaning.merged_events(self.demo_clean, self.web_with_groups),
                          "merged-events")

    @cached_property
    def kpi_population(self) -> DataFrame:
        return self.stage(cleaning.kpi_population(self.demo_clean, self.web_with_groups),
                          "kpi-population")

    @cached_property
    def assigned_clients(self) -> DataFrame:
        return cleaning.assigned_clients(self.domain.experiment, self.demo_clean)

    # -- sequences ---------------------------------------------------------------------
    @cached_property
    def kpi_events(self) -> DataFrame:
        return self.stage(sessions.kpi_events(self.kpi_population, self.mode), "kpi-events")

    @cached_property
    def traces(self) -> DataFrame:
        """The flagged events laid out for lookups of a client or a visit."""
        return clustered_table(self.kpi_events, "traces", ["client_id", "date_time", "event_seq"],
                               bloom=["visit_id"])

    @cached_property
    def process_durations(self) -> DataFrame:
        return self.stage(durations.process_durations(self.merged_events, self.mode),
                          "process-durations")

    @cached_property
    def completion_durations(self) -> DataFrame:
        return durations.completion_durations(self.process_durations)

    # -- sketches ------------------------------------------------------------------------
    @cached_property
    def step_sketches(self) -> DataFrame:
        """Clients per arm, step and day of the merged events."""
        return self.stage(sketches.client_sketches(self.merged_events, "variation",
                                                   "process_step"), "step-sketches")

    @cached_property
    def finish_sketches(self) -> DataFrame:
        """Clients per arm, finish flag and day of the flagged events."""
        return self.stage(sketches.client_sketches(self.kpi_events, "variation", "finish"),
                          "finish-sketches")

    @cached_property
    def duration_sketches(self) -> DataFrame:
        """Step seconds per arm, step and day of the kept rows."""
        kept = self.process_durations.withColumn("day", F.col("date_time").cast("date"))
        return self.stage(sketches.value_sketches(kept, "step_duration_sec", "variation",
                                                  "process_step", "day"), "duration-sketches")
