"""Relational, temporal, identity and graph operators (DataFrame in, DataFrame out)."""
