"""Corpus curation on Spark: declarative operators for filtering, classifying, deduplicating, sampling,
splitting, reporting on and evaluating instruction-tuning data."""
