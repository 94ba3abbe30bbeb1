"""DataFrame operators: key tables, lookups, matching, reports."""
