"""Errors of the library, all under one base."""


class SpanSenseError(Exception):
    """Base of all errors."""


class ConfigError(SpanSenseError):
    """A setting is missing or contradictory."""


class LimitError(SpanSenseError, ValueError):
    """Something exceeds what one request or question may hold."""


class BudgetExceeded(SpanSenseError):
    """The estimated cost lies above the cap."""


class BackendError(SpanSenseError):
    """A judge answered wrongly or not at all."""

    def __init__(self, message: str, status: int | None = None, retryable: bool = False) -> None:
        super().__init__(message)
        self.status, self.retryable = status, retryable


class CacheMiss(SpanSenseError):
    """A replay asked for a decision that isn't recorded."""


class RefusedError(SpanSenseError):
    """A judge refused a question."""


class DefinitionError(SpanSenseError, ValueError):
    """A semantic program is wrongly defined."""


class InputError(SpanSenseError, ValueError):
    """Records don't fit the program."""


class PlanMismatch(SpanSenseError):
    """Settings changed between planning and evaluation."""


class PlanningLimitExceeded(SpanSenseError):
    """Planning takes more steps than allowed."""


class CandidateLimitExceeded(PlanningLimitExceeded):
    """More candidates than allowed."""


class RequestLimitExceeded(PlanningLimitExceeded):
    """More requests than allowed."""


class ResultLimitExceeded(SpanSenseError):
    """More results than allowed."""


class DeadlineExceeded(SpanSenseError):
    """The run took too long."""


class UnsupportedCapability(SpanSenseError):
    """The judge can't do what the program needs."""


class EvaluationFailed(SpanSenseError):
    """An evaluation is incomplete; ``partial`` holds what there is, ``causes`` why."""

    def __init__(self, message: str, partial=None, causes=()) -> None:
        super().__init__(message)
        self.partial, self.causes = partial, tuple(causes)
