"""Query plans: daily and weekly reports, lists and lookups."""
