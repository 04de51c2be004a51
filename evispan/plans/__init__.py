"""Compositions of operators: answers, research rounds, reports."""
