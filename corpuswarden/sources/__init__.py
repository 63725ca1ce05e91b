"""Scans that turn files, texts and nested catalogs into rows, and the sinks."""
