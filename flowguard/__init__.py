"""Flowguard: telemetry preparation, drift, alerting and review loops on Spark."""
