"""Errors of the query language and the graph."""


class GraphError(RuntimeError):
    """Anything wrong with a statement or with what it would do."""


class ParseError(GraphError):
    """A statement that isn't in the language."""


class ConstraintViolation(GraphError):
    """A write that a constraint forbids."""
