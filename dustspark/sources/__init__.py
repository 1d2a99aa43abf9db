"""Readers, writers and fixture adapters."""
