"""Host-fleet telemetry on Spark: envelopes, snapshots, metrics, registry, sessions."""
