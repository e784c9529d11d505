"""Uplift analytics on Spark: trial data, effect scores, ranking metrics, resampling and robustness tables."""
