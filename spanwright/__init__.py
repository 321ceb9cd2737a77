"""Forensics of AI-pipeline traces on Spark: rules, health, blame, drift, clusters, replay."""
