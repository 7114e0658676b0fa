"""Column functions; see :mod:`melisma.functions.scalar`."""
