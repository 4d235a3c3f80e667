"""Errors raised while a plan is composed; row-level checks raise inside Spark."""


class VectorError(Exception):
    """Base; ``code`` is a stable identifier."""

    code = "VECTOR_ERROR"


class DimensionError(VectorError):
    code = "DIMENSION_MISMATCH"

    def __init__(self, expected: int, got: int, context: str = ""):
        super().__init__(f"{context + ': ' if context else ''}expected dimension {expected}, got {got}")
        self.expected, self.got = expected, got


class ValidationError(VectorError):
    code = "VALIDATION"

    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field = field


class StepError(VectorError):
    code = "PIPELINE"

    def __init__(self, index: int, kind: str, message: str):
        super().__init__(f"step {index} ({kind}): {message}")
        self.index, self.kind = index, kind


def positive_int(value, field: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValidationError(field, "must be a positive integer")
    return value


def positive(value, field: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not value > 0 or value == float("inf"):
        raise ValidationError(field, "must be a positive finite number")
    return float(value)
