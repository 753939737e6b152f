"""Error kinds, the place they were met, and the exception that carries both."""

from __future__ import annotations

from dataclasses import dataclass


class Kind:
    """Names of error kinds, as they stand in ``_error`` columns."""

    IO = "Io"
    INVALID_UTF8 = "InvalidUtf8"
    EMPTY_FIELD = "EmptyField"
    INVALID_DIGIT = "InvalidDigit"
    OUT_OF_RANGE = "OutOfRange"
    INVALID_VALUE = "InvalidValue"
    CONFIGURATION = "Configuration"
    MISSING_HEADER = "MissingHeader"
    DUPLICATE_HEADER = "DuplicateHeader"
    DECODE = "Decode"
    REJECTED_BOM = "RejectedBom"
    UNTERMINATED_QUOTED_FIELD = "UnterminatedQuotedField"
    UNEXPECTED_QUOTE = "UnexpectedQuote"
    UNEXPECTED_BYTE_AFTER_QUOTE = "UnexpectedByteAfterQuote"
    INVALID_ESCAPE = "InvalidEscape"
    INVALID_RECORD_ENDING = "InvalidRecordEnding"
    RECORD_TOO_LARGE = "RecordTooLarge"
    FIELD_TOO_LARGE = "FieldTooLarge"
    TOO_MANY_FIELDS = "TooManyFields"
    FIELD_COUNT_MISMATCH = "FieldCountMismatch"
    PARSER_FAILED = "ParserFailed"
    ENCODE = "Encode"
    EMITTER_FAILED = "EmitterFailed"
    UNTERMINATED_RECORD = "UnterminatedRecord"
    LOCATION_OVERFLOW = "LocationOverflow"
    SOURCE_MISMATCH = "SourceMismatch"
    RECORD_OUT_OF_RANGE = "RecordOutOfRange"
    INVALID_INDEX = "InvalidIndex"


ERROR_TYPE = "struct<kind:string,byte:bigint,line:bigint,record:bigint,field:bigint>"
LOCATION_TYPE = "struct<byte:bigint,line:bigint,record:bigint,field:bigint>"


@dataclass(frozen=True)
class Location:
    """Byte offset, physical line (from 1), record and field, all but the line from 0."""

    byte: int = 0
    line: int = 1
    record: int = 0
    field: int = 0


class QuillError(Exception):
    def __init__(self, kind: str, detail: str = "", location: Location | None = None, name: str | None = None) -> None:
        self.kind, self.detail, self.location, self.name = kind, detail, location, name
        at = f" at byte {location.byte}, line {location.line}, record {location.record}, field {location.field}" if location else ""
        super().__init__(f"{kind}{f': {detail}' if detail else ''}{f' ({name})' if name else ''}{at}")

    def __reduce__(self):
        return type(self), (self.kind, self.detail, self.location, self.name)


def configuration(reason: str) -> QuillError:
    return QuillError(Kind.CONFIGURATION, reason)
