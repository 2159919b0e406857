"""Corpus scans and the analysis-document and graph sinks."""
