"""Errors of schema declarations and of batches."""

from __future__ import annotations


class SchemaError(ValueError):
    """A declaration that does not make a schema. kind: missing_option, invalid_option, invalid_schema or syntax."""

    def __init__(self, kind: str, reason: str):
        super().__init__(f"{kind}: {reason}")
        self.kind, self.reason = kind, reason


class BatchError(ValueError):
    """A batch that breaks a rule; code is one of CODES."""

    def __init__(self, code: str, detail: object = ""):
        super().__init__(f"{code}: {detail}" if detail != "" else code)
        self.code, self.detail = code, detail


#: The names under which rules report.
CODES = (
    "CorruptMagic",
    "UnsupportedTransportVersion",
    "UnsupportedEncodingKind",
    "InvalidFlags",
    "InvalidHeaderLength",
    "UnknownSchemaId",
    "SchemaVersionMismatch",
    "SchemaHashMismatch",
    "PayloadLengthMismatch",
    "PayloadChecksumMismatch",
    "TruncatedPayload",
    "MalformedArchive",
    "RowCountMismatch",
    "InvalidEnumOrdinal",
    "InvalidBitmask",
    "InvalidTimeGrid",
    "NonFiniteNumeric",
    "InvalidPresenceBits",
    "InvalidPresenceWord",
    "ResponseTooLarge",
)
