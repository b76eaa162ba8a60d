"""Alerting: rules, evaluation on a grid, pending/firing state, inhibition, routing, notification."""
