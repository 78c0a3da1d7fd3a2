"""Column helpers: pure functions from columns and parameters to columns."""
