"""Incremental index builds."""
