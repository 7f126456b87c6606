"""Readers of event tables, binary traces, tree dumps, memory maps and symbols files."""
