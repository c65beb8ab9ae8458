"""Scoring models."""
