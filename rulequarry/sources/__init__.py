"""Readers and writers of rules, logs, statuses, RDF and reports."""
