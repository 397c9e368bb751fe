"""Registered queries, their SQL twins and the end-to-end job plans."""
