"""Plans: check specs, policies, the suite planner, scoring and reports."""
