"""A DataFrame engine that builds, checks and refreshes documentation corpora."""
