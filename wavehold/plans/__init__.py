"""Reusable multi-stage plans: ranking, exact quantiles, resampling, decisions."""
