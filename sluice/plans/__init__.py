"""Registered queries of the evaluation regimes and their SQL."""
