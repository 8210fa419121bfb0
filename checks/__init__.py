"""Every operator applied to the given tables, each with its SQL twin."""
