"""buildtrail: DataFrame operators for build-farm telemetry, content stores and training corpora."""
