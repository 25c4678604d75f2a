"""Warehouse builders, feature plans and the driver query catalogue."""
