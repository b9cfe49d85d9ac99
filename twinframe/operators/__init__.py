"""Relational operators over the ``files`` and ``nodes`` relations."""
