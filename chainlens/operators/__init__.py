"""Analytic jobs (DataFrame -> DataFrame)."""
