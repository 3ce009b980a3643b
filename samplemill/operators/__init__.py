"""Stages, by kind."""
