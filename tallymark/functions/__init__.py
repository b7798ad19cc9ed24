"""Functions that users bring: analyzers, skills, models and scores, by name."""
