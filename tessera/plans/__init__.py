"""Composite plans built from the operators: document cleaning, tasks, valuation, reports."""
