"""Readers and writers for bibliographic files."""
