"""Inventory-panel analytics on Spark: classify, forecast, simulate and compare policies."""
