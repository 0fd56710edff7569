"""Readers, writers and derived fixture views."""
