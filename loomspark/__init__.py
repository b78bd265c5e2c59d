"""PySpark analytics over text and source-code corpora."""
