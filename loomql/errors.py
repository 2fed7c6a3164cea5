"""Errors that the builder, the gate and the writes raise."""


class LoomError(Exception):
    pass


class InvalidReference(LoomError):
    """A name, operator or raw fragment that isn't allowed."""


class NotFound(LoomError):
    """No row where one is needed."""


class Conflict(LoomError):
    """A key that is already there."""


class Blocked(LoomError):
    """A plan that never runs."""


class ApprovalRequired(LoomError):
    """A plan that runs only with a stated reason."""


class RowsAffected(LoomError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected {expected} rows, {actual} are affected")
        self.expected, self.actual = expected, actual


def is_not_found(error: BaseException) -> bool:
    return isinstance(error, NotFound)


def is_conflict(error: BaseException) -> bool:
    return isinstance(error, Conflict)
