"""Table operators: rules, scoring, dedup, ledger, preferences, health, reports."""
