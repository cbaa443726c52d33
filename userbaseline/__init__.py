"""User-behaviour analytics on Spark: daily features, own-history baselines, flags, verdicts."""
