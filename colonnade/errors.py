"""One exception for everything that is refused while a plan is built."""

from __future__ import annotations


class EngineError(ValueError):
    """``code`` is one of the constants below; no check ever runs a job."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


UNSUPPORTED_DTYPE = "UNSUPPORTED_DTYPE"
DTYPE_MISMATCH = "DTYPE_MISMATCH"
COLUMN_SIZE_MISMATCH = "COLUMN_SIZE_MISMATCH"
UNSUPPORTED_METHOD = "UNSUPPORTED_METHOD"
UNSUPPORTED_JOIN_TYPE = "UNSUPPORTED_JOIN_TYPE"
JOIN_DTYPE_MISMATCH = "JOIN_DTYPE_MISMATCH"
DATASET_EMPTY = "DATASET_EMPTY"
INVALID_API_CALL = "INVALID_API_CALL"
VALIDITY_MISSING = "VALIDITY_MISSING"
UNKNOWN_COLUMN = "UNKNOWN_COLUMN"


def require(condition: bool, code: str, message: str = "") -> None:
    if not condition:
        raise EngineError(code, message)
