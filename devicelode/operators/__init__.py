"""DataFrame -> DataFrame operators, by subject."""
