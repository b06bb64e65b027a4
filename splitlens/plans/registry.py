"""Query registry: one lazy Spark query per key of SURVEY section 2.12."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (balance, bootstrap, cleaning, dashboards, durations, funnel, kpis,
                         profile, sessions, sketches, slices, stats)
from ..sources import csv, dialect, locale
from ..sources.stage import stage_path, stage_table
from .pipeline import Stages

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Callable[[Stages], DataFrame]] = {}


def query(key: str):
    def deco(fn: Callable[[Stages], DataFrame]):
        REGISTRY[key] = fn
        return fn
    return deco


def queries(mode: str = "segmented", materialize: bool = True) -> dict[str, QueryFn]:
    """Bind every registered query to the session's shared stage tables."""
    def bind(fn):
        return lambda spark, sf_dir: fn(Stages.shared(spark, sf_dir, mode, materialize))
    return {key: bind(fn) for key, fn in REGISTRY.items()}


# -- cleaning and joins ----------------------------------------------------------------
@query("web_log_clean")
def _web_log_clean(s: Stages) -> DataFrame:
    return s.web_log_clean


@query("web_with_groups")
def _web_with_groups(s: Stages) -> DataFrame:
    return s.web_with_groups


@query("demo_clean")
def _demo_clean(s: Stages) -> DataFrame:
    return s.demo_clean


@query("master")
def _master(s: Stages) -> DataFrame:
    return s.master


@query("merged_events")
def _merged_events(s: Stages) -> DataFrame:
    return s.merged_events


@query("kpi_population")
def _kpi_population(s: Stages) -> DataFrame:
    return s.kpi_population


# -- sequences and KPIs ----------------------------------------------------------------
@query("error_flags")
def _error_flags(s: Stages) -> DataFrame:
    return sessions.error_flags(s.kpi_population, s.mode).select(
        "client_id", "visit_id", "event_seq", "step_num", "step_diff", "is_error")


@query("error_rate_by_step")
def _error_rate_by_step(s: Stages) -> DataFrame:
    return kpis.error_rate_by_step(s.kpi_events)


@query("error_rate_pivot")
def _error_rate_pivot(s: Stages) -> DataFrame:
    return kpis.error_rate_pivot(s.kpi_events)


@query("error_summary")
def _error_summary(s: Stages) -> DataFrame:
    return kpis.error_summary(s.kpi_events)


@query("attempts")
def _attempts(s: Stages) -> DataFrame:
    return s.kpi_events.select("client_id", "event_seq", "step_num", "attempt_no")


@query("attempts_documented")
def _attempts_documented(s: Stages) -> DataFrame:
    flagged = sessions.error_flags(s.kpi_population, s.mode)
    return sessions.attempts_documented(flagged, s.mode).select(
        "client_id", "event_seq", "step_num", "attempt_no")


@query("finishers")
def _finishers(s: Stages) -> DataFrame:
    return kpis.finishers(s.kpi_events)


@query("finisher_rate")
def _finisher_rate(s: Stages) -> DataFrame:
    return kpis.finisher_rate(s.kpi_events)


@query("total_attempts")
def _total_attempts(s: Stages) -> DataFrame:
    return kpis.total_attempts(s.kpi_events)


@query("finished_attempts")
def _finished_attempts(s: Stages) -> DataFrame:
    return kpis.finished_attempts(s.kpi_events)


@query("completion_rate")
def _completion_rate(s: Stages) -> DataFrame:
    return kpis.completion_rate(s.kpi_events)


@query("kpi_summary")
def _kpi_summary(s: Stages) -> DataFrame:
    return kpis.kpi_summary(s.kpi_events)


@query("retry_clients")
def _retry_clients(s: Stages) -> DataFrame:
    return kpis.retry_clients(s.kpi_events)


# -- visits, durations, funnel ---------------------------------------------------------
@query("steps_by_visit")
def _steps_by_visit(s: Stages) -> DataFrame:
    return sessions.steps_by_visit(s.merged_events, s.mode).select(
        "client_id", "visit_id", "event_seq", "n_of_unique_steps", "completed_steps")


@query("client_last_visit")
def _client_last_visit(s: Stages) -> DataFrame:
    return sessions.client_last_visit(s.merged_events)


@query("process_durations")
def _process_durations(s: Stages) -> DataFrame:
    return s.process_durations


@query("step_by_step_durations")
def _step_by_step_durations(s: Stages) -> DataFrame:
    return durations.step_by_step(s.process_durations)


@query("completion_durations")
def _completion_durations(s: Stages) -> DataFrame:
    return s.completion_durations


@query("duration_stats")
def _duration_stats(s: Stages) -> DataFrame:
    return durations.duration_stats(s.completion_durations)


@query("funnel")
def _funnel(s: Stages) -> DataFrame:
    return funnel.funnel(s.merged_events)


@query("funnel_pivot")
def _funnel_pivot(s: Stages) -> DataFrame:
    return funnel.funnel_pivot(s.merged_events)


@query("step_distribution")
def _step_distribution(s: Stages) -> DataFrame:
    return funnel.step_distribution(s.merged_events)


@query("step_distribution_pct")
def _step_distribution_pct(s: Stages) -> DataFrame:
    return funnel.step_distribution_pct(s.merged_events)


@query("steps_crosstab")
def _steps_crosstab(s: Stages) -> DataFrame:
    return funnel.steps_crosstab(s.merged_events)


# -- populations and labels -------------------------------------------------------------
@query("valid_groups")
def _valid_groups(s: Stages) -> DataFrame:
    return cleaning.valid_groups(s.master)


@query("group_labels")
def _group_labels(s: Stages) -> DataFrame:
    return cleaning.group_labels(s.domain.experiment, s.demo_clean)


@query("group_fold_sensitivity")
def _group_fold_sensitivity(s: Stages) -> DataFrame:
    return cleaning.group_fold_sensitivity(s.domain.experiment, s.demo_clean)


# -- balance ------------------------------------------------------------------------------
@query("balance_describe")
def _balance_describe(s: Stages) -> DataFrame:
    return balance.balance_describe(s.assigned_clients)


@query("gender_crosstab")
def _gender_crosstab(s: Stages) -> DataFrame:
    return balance.gender_crosstab(s.assigned_clients)


@query("balance_by_gender")
def _balance_by_gender(s: Stages) -> DataFrame:
    return balance.balance_by_gender(s.assigned_clients)


@query("balance_boxplot")
def _balance_boxplot(s: Stages) -> DataFrame:
    return balance.balance_boxplot(s.assigned_clients)


@query("histogram_age")
def _histogram_age(s: Stages) -> DataFrame:
    return balance.histogram(s.assigned_clients, "clnt_age")


@query("histogram_tenure")
def _histogram_tenure(s: Stages) -> DataFrame:
    return balance.histogram(s.assigned_clients, "clnt_tenure_yr")


@query("age_tenure_relation")
def _age_tenure_relation(s: Stages) -> DataFrame:
    return balance.age_tenure_relation(s.assigned_clients)


@query("age_tenure_bins")
def _age_tenure_bins(s: Stages) -> DataFrame:
    return balance.age_tenure_bins(s.assigned_clients)


@query("balance_bootstrap")
def _balance_bootstrap(s: Stages) -> DataFrame:
    known = balance.assigned(s.assigned_clients).where(F.col("gendr").isNotNull())
    return bootstrap.intervals(known, "client_id", ["variation", "gendr"], balance.METRICS)


@query("age_tenure_density")
def _age_tenure_density(s: Stages) -> DataFrame:
    return balance.density(s.assigned_clients)


# -- sketches: the same counts and quantiles, mergeable ----------------------------------
@query("step_clients_sketched")
def _step_clients_sketched(s: Stages) -> DataFrame:
    return sketches.step_clients(s.step_sketches)


@query("daily_clients_sketched")
def _daily_clients_sketched(s: Stages) -> DataFrame:
    return sketches.daily_clients(s.step_sketches)


@query("finisher_rate_sketched")
def _finisher_rate_sketched(s: Stages) -> DataFrame:
    return sketches.finisher_rate(s.finish_sketches)


@query("arm_overlap_sketched")
def _arm_overlap_sketched(s: Stages) -> DataFrame:
    return sketches.arm_overlap(s.finish_sketches)


@query("balance_quantiles")
def _balance_quantiles(s: Stages) -> DataFrame:
    clients = balance.assigned(s.assigned_clients)
    return sketches.quantiles(sketches.value_sketches(clients, "bal", "variation"))


@query("step_duration_quantiles")
def _step_duration_quantiles(s: Stages) -> DataFrame:
    return sketches.quantiles(sketches.merged_values(s.duration_sketches, "variation",
                                                     "process_step"))


# -- dashboards ---------------------------------------------------------------------------
@query("duration_by_age")
def _duration_by_age(s: Stages) -> DataFrame:
    return dashboards.duration_by_age(s.completion_durations)


@query("duration_by_gender")
def _duration_by_gender(s: Stages) -> DataFrame:
    return dashboards.duration_by_gender(s.completion_durations)


@query("step_duration_by_arm")
def _step_duration_by_arm(s: Stages) -> DataFrame:
    return dashboards.step_duration_by_arm(s.process_durations)


@query("step_duration_by_age")
def _step_duration_by_age(s: Stages) -> DataFrame:
    return dashboards.step_duration_by_age(s.process_durations)


@query("step_duration_by_gender")
def _step_duration_by_gender(s: Stages) -> DataFrame:
    return dashboards.step_duration_by_gender(s.process_durations)


@query("duration_log_distribution")
def _duration_log_distribution(s: Stages) -> DataFrame:
    return dashboards.duration_log_distribution(s.completion_durations)


# -- tests ----------------------------------------------------------------------------------
@query("ztest_completion")
def _ztest_completion(s: Stages) -> DataFrame:
    return stats.ztest_completion(s.kpi_events)


@query("ztest_error_rate")
def _ztest_error_rate(s: Stages) -> DataFrame:
    return stats.ztest_error_rate(s.kpi_events)


@query("welch_duration")
def _welch_duration(s: Stages) -> DataFrame:
    return stats.welch_duration_test(s.completion_durations)


@query("arm_overlap")
def _arm_overlap(s: Stages) -> DataFrame:
    return stats.arm_overlap(s.kpi_events)


# -- profiles -------------------------------------------------------------------------------
@query("duplicate_counts")
def _duplicate_counts(s: Stages) -> DataFrame:
    return profile.duplicate_counts({
        "web_pt1": (s.domain.web_pt1, None),
        "web_pt2": (s.domain.web_pt2, None),
        "web_log_clean": (s.web_log_clean, None),
        "experiment": (s.domain.experiment, None),
        "experiment_client_id": (s.domain.experiment, ["client_id"]),
        "demographics_client_id": (s.demo_clean, ["client_id"]),
    })


@query("duplicate_rows")
def _duplicate_rows(s: Stages) -> DataFrame:
    return profile.duplicate_rows(s.domain.web_pt1, "web_pt1").unionByName(
        profile.duplicate_rows(s.domain.web_pt2, "web_pt2"))


@query("distinct_values")
def _distinct_values(s: Stages) -> DataFrame:
    return profile.distinct_values(s.master, ["variation", "process_step", "gendr"])


def _profiled_tables(s: Stages) -> dict[str, DataFrame]:
    return {"experiment": s.domain.experiment, "demographics": s.domain.demographics,
            "web_log_clean": s.web_log_clean, "master": s.master}


@query("null_profile")
def _null_profile(s: Stages) -> DataFrame:
    return profile.null_profile(_profiled_tables(s))


@query("table_profile")
def _table_profile(s: Stages) -> DataFrame:
    return profile.table_profile(_profiled_tables(s))


@query("null_age_by_arm")
def _null_age_by_arm(s: Stages) -> DataFrame:
    return profile.null_age_by_arm(s.master)


@query("visitors_per_visit")
def _visitors_per_visit(s: Stages) -> DataFrame:
    return profile.visitors_per_visit(s.kpi_population)


TRACE_COLUMNS = ["client_id", "variation", "visitor_id", "visit_id", "process_step",
                 "date_time", "event_seq", "step_num", "is_error", "attempt_no", "finish"]


TRACED_CLIENT, TRACED_VISIT = 6, "2_9"


@query("client_trace")
def _client_trace(s: Stages) -> DataFrame:
    return profile.client_trace(s.kpi_events, TRACE_COLUMNS)


@query("client_trace_by_client")
def _client_trace_by_client(s: Stages) -> DataFrame:
    return profile.trace(s.traces, TRACE_COLUMNS, client=TRACED_CLIENT)


@query("client_trace_by_visit")
def _client_trace_by_visit(s: Stages) -> DataFrame:
    return profile.trace(s.traces, TRACE_COLUMNS, visit=TRACED_VISIT)


HEAD_COLUMNS = ["date_time", "event_seq", "client_id", "visitor_id", "visit_id", "process_step"]


@query("web_log_head")
def _web_log_head(s: Stages) -> DataFrame:
    return slices.head(s.web_log_clean, HEAD_COLUMNS, 20)


@query("web_log_tail")
def _web_log_tail(s: Stages) -> DataFrame:
    return slices.tail(s.web_log_clean, HEAD_COLUMNS, 20)


@query("client_first_steps")
def _client_first_steps(s: Stages) -> DataFrame:
    own = s.web_with_groups.select("client_id", "date_time", "event_seq", "process_step")
    return slices.first_per_key(own, ["client_id"], ["date_time", "event_seq"], 3)


# -- exports, sources and sinks -------------------------------------------------------------
EXPORT_COLUMNS = ["client_id", "clnt_tenure_yr", "clnt_age", "gendr", "variation", "visit_id",
                  "process_step", "is_error", "attempt_no", "finish"]


@query("tableau_export")
def _tableau_export(s: Stages) -> DataFrame:
    return s.kpi_events.select(*EXPORT_COLUMNS)


@query("src_csv_typed")
def _src_csv_typed(s: Stages) -> DataFrame:
    path = csv.write_csv(s.web_log_clean, stage_path(s.spark, "web_log_csv"))
    return csv.read_csv_typed(s.spark, path, s.web_log_clean.schema, sep=",")


@query("src_csv_semicolon")
def _src_csv_semicolon(s: Stages) -> DataFrame:
    path = csv.write_csv(s.process_durations, stage_path(s.spark, "durations_csv"),
                         sep=";")
    return csv.read_csv_typed(s.spark, path, s.process_durations.schema, sep=";")


@query("src_csv_dialects")
def _src_csv_dialects(s: Stages) -> DataFrame:
    """Two parts in dialects of their own (one with a byte-order mark and other separators)
    under one folder, read as one table."""
    path = stage_path(s.spark, "dialects_csv")
    first, second = s.domain.web_pt1.dropDuplicates(), s.domain.web_pt2.dropDuplicates()
    csv.write_csv(first, f"{path}/pt1", sep=",")
    marked = second.withColumnRenamed("client_id", "\ufeffclient_id")
    csv.write_csv(marked, f"{path}/pt2", sep=";")
    return dialect.read_csv(s.spark, path, s.web_log_clean.schema)


@query("src_csv_locale")
def _src_csv_locale(s: Stages) -> DataFrame:
    path = locale.write_csv_fr(s.process_durations, stage_path(s.spark, "durations_fr"))
    return locale.read_csv_fr(s.spark, path, s.process_durations.schema)


@query("sink_roundtrip")
def _sink_roundtrip(s: Stages) -> DataFrame:
    return stage_table(s.kpi_events.select(*EXPORT_COLUMNS), "tableau_export")
