"""Errors with a stable kind, cause and code."""

from __future__ import annotations

#: The kinds, and the cause that each belongs to.
KINDS = {
    "invalid_input": "invalid_input",
    "unsupported_format": "unsupported_format",
    "corrupt_file": "corrupt_file",
    "unsupported_schema_version": "unsupported_format",
    "invalid_manifest": "invalid_input",
    "unsafe_manifest_path": "invalid_input",
    "missing_artifact": "io",
    "fixed_binary_width_mismatch": "invalid_input",
    "payload_header_mismatch": "corrupt_file",
    "payload_crc_mismatch": "corrupt_file",
    "channel_id_mismatch": "corrupt_file",
    "biz_index_duplicate": "corrupt_file",
    "biz_index_gap": "corrupt_file",
    "biz_index_regression": "corrupt_file",
    "row_count_mismatch": "corrupt_file",
    "checksum_mismatch": "corrupt_file",
    "lock_unavailable": "lock_unavailable",
    "io": "io",
}
#: Error codes.
CODES = {"ok": 0, "invalid_argument": 1, "unimplemented": 2, "io": 3, "decode": 4}


class TableError(Exception):
    """kind: one of KINDS. cause: the coarser class. code: the stable number."""

    def __init__(self, kind: str, message: str, code: str | None = None):
        super().__init__(f"{kind}: {message}")
        self.kind = kind
        self.cause = KINDS.get(kind, kind)
        self.code = CODES[code or ("io" if self.cause == "io" else "invalid_argument")]


class Unimplemented(TableError):
    def __init__(self, message: str):
        super().__init__("unsupported_format", message, "unimplemented")


def invalid(message: str) -> TableError:
    return TableError("invalid_input", message)
