"""DataFrame-to-DataFrame operators: selection, budgets, metrics, audits."""
