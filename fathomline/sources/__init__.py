"""Readers, writers, index storage and pluggable models."""
