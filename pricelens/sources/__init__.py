"""Scans, landed-document parsers and sinks."""
