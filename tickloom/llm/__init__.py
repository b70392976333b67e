"""Operators for preparing training text at scale; queries in ``queries``."""
