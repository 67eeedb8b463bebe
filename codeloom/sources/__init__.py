"""Readers and writers: repositories, manifests, contracts, labels, traces and graph files."""
