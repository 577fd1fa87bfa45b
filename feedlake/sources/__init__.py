"""Readers that turn landed files and configuration into typed DataFrames."""
