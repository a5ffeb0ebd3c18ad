"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; the driver entry adds its queries
only when it can be imported.
"""
