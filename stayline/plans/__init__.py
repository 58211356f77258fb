"""Compositions: labels, cohorts, model jobs, explanations."""
