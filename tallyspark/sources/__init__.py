"""Typed readers, report sinks and the mapping of the driver tables to engine tables."""
