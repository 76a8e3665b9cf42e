"""A PySpark engine for searching and refining a corpus of source-code chunks and texts."""
