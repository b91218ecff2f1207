"""Contracts of the dataset types: which columns an upload must have."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Contract:
    division: str
    division_label: str
    kind: str
    kind_label: str
    required: tuple[str, ...]


#: Divisions, dataset types, and their required columns in order.
CONTRACTS = (
    Contract("network_operation", "Network Operation", "daily_fiber_inspection", "Daily Fiber Inspection", ("inspection_date", "fiber_id", "status", "technician")),
    Contract("network_operation", "Network Operation", "outage_report", "Outage Report", ("outage_date", "region", "duration_minutes", "cause")),
    Contract("customer_service", "Customer Service", "ticket_log", "Ticket Log", ("ticket_id", "customer_id", "opened_date", "status")),
    Contract("customer_service", "Customer Service", "satisfaction_survey", "Satisfaction Survey", ("survey_date", "customer_id", "score")),
    Contract("finance", "Finance", "invoice_summary", "Invoice Summary", ("invoice_date", "region", "amount")),
)


def contract_of(division: str, kind: str) -> Contract | None:
    return next((c for c in CONTRACTS if (c.division, c.kind) == (division, kind)), None)


def contract_table(spark: SparkSession) -> DataFrame:
    rows = [(c.division, c.division_label, c.kind, c.kind_label, list(c.required)) for c in CONTRACTS]
    return spark.createDataFrame(rows, "division_id string, division_label string, type_id string, type_label string, required_columns array<string>")


def division_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted({(c.division, c.division_label) for c in CONTRACTS}), "division_id string, division_label string")
