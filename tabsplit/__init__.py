"""Shared-bill analytics on Spark: receipts to line items, claims to exact shares."""
