"""Readers for the input tables and a shared scratch area for intermediate tables."""
