"""Denial constraints, injection, hitting sets, measures, supports and weights."""
