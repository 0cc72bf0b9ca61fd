"""Whole programs: model learners, simulator, comparators, validators."""
