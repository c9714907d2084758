"""Readers and writers of manifests, label sources, histories, run stores and exports."""
