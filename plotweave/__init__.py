"""DataFrame operators for large tables of symbols detected in technical drawings."""
