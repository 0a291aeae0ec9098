"""Readers and writers for dataset folders, ARFF, logs, results and vectors."""
