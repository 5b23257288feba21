"""Errors that callers can tell apart."""


class GraphInputError(ValueError):
    """An edge list can't define a graph."""


class MLInputError(ValueError):
    """Labels or graphs don't suffice for a supervised task."""


class GraphTooLarge(ValueError):
    """A sequential kernel was asked for a graph beyond its checked size."""
