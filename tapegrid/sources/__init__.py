"""Readers, writers and bar builders."""
