"""Master table, KPIs, breakdowns and reports."""
