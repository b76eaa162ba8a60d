"""Inputs and outputs: sample tables, exposition text, JSON reports, logs, retention."""
