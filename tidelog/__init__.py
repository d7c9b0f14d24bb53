"""tidelog: a PySpark engine for transactional change logs, with an optional ``llm`` subpackage."""
