"""DataFrame operators for ordinal predictions: lazy, composable, with cohorts, strata and draws as grouping keys."""
