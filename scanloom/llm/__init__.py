"""Operators for the training corpus. Nothing outside this subpackage imports it."""
