"""Operators that prepare a training corpus. Nothing else in the library imports this subpackage."""
