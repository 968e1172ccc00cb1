"""Structured Streaming: complete clean and KPI tables with a live path, and watermarked variants."""

from clickweave.streaming.complete import stream_table
from clickweave.streaming.dedup import stream_clean
from clickweave.streaming.kpis import stream_daily_kpis

__all__ = ["stream_clean", "stream_daily_kpis", "stream_table"]
