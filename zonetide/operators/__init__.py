"""Demand, spatial and time-series operators."""
