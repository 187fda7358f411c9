"""Who reads, and with which clearance."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_CLEARANCE = 2
HIGHEST_CLEARANCE = 3
#: What a role may do beside reading its application's rows: an owner reads and writes all of an application, an administrator all.
ROLES = ("reader", "writer", "owner", "admin")


@dataclass(frozen=True)
class AccessContext:
    """An application's view of the data. clearance None: nothing is visible."""

    app_id: str
    clearance: int | None = DEFAULT_CLEARANCE
    request_id: str = ""
    role: str = "writer"

    def __post_init__(self):
        if self.role not in ROLES:
            raise ValueError(f"role must be one of {ROLES}: {self.role}")

    @property
    def may_write(self) -> bool:
        return self.role != "reader"

    @classmethod
    def of(cls, app_id: str, clearance: int | None = None, default: int = DEFAULT_CLEARANCE, request_id: str = "") -> AccessContext:
        """A request's context. The default stands in for None alone: clearance 0 stays 0."""
        value = default if clearance is None else int(clearance)
        if not 0 <= value <= HIGHEST_CLEARANCE:
            raise ValueError(f"clearance must be 0 to {HIGHEST_CLEARANCE}: {value}")
        return cls(app_id, value, request_id)
