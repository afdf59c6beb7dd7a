"""Text operators for training-data pipelines; nothing outside this subpackage imports it."""
