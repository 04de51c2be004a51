"""Column functions: text normalisation, labels, guardrail predicates."""
