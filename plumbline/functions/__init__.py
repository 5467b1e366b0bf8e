"""Column builders: pure functions from columns to columns."""
