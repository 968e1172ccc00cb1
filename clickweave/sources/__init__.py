"""Event sources: CSV ingest, the month-partitioned event table, the driver-table fixture."""

from clickweave.sources.ingest import export_csv, ingest_events
from clickweave.sources.tables import read_event_table, write_event_table
from clickweave.sources.fixtures import commerce_events

__all__ = ["export_csv", "ingest_events", "read_event_table", "write_event_table", "commerce_events"]
