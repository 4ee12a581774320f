"""Data model: schemas, enumerations, limits, validated settings and error codes."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Names and numbers of the data model.
OP_KINDS = {0: "INVALID", 1: "PUT", 2: "DELETE"}
ROLES = {0: "Follower", 1: "Candidate", 2: "Leader"}
MESSAGE_TYPES = {0: "RequestVote", 1: "RequestVoteResp", 2: "Append", 3: "AppendResp"}
ENGINE_STATES = {0: "Recovering", 1: "Serving", 2: "Closing", 3: "Closed", 4: "Faulted"}
ERROR_CODES = {
    0: "UNKNOWN", 1: "INVALID_ARGUMENT", 2: "REQUEST_ID_REUSE", 3: "DUPLICATE_RESULT_EXPIRED", 4: "SEQUENCE_GAP",
    5: "RESOURCE_EXHAUSTED", 6: "CANCELED", 7: "SNAPSHOT_IN_PROGRESS", 8: "FAULTED", 9: "CLOSED", 10: "CORRUPTION", 11: "STORAGE", 12: "LOCKED",
}
OBSERVATION_KINDS = {
    0: "role_change", 1: "term_advanced", 2: "election_started", 3: "election_won", 4: "election_lost", 5: "vote_granted",
    6: "vote_denied", 7: "append_rejected", 8: "log_truncated", 9: "commit_advanced", 10: "progress_reset",
}
ENUMS = {"op_kind": OP_KINDS, "role": ROLES, "message_type": MESSAGE_TYPES, "engine_state": ENGINE_STATES, "error_code": ERROR_CODES, "observation_kind": OBSERVATION_KINDS}
# Whether a command with this code ran: it did not, that is unknown, or the engine refused it.
CERTAINTY = {
    "INVALID_ARGUMENT": "not_executed", "REQUEST_ID_REUSE": "not_executed", "DUPLICATE_RESULT_EXPIRED": "not_executed", "SEQUENCE_GAP": "not_executed",
    "RESOURCE_EXHAUSTED": "not_executed", "STORAGE": "unknown", "CANCELED": "not_executed", "CANCELED_QUEUED": "unknown", "FAULTED": "refused",
    "CLOSED": "refused", "LOCKED": "refused", "SNAPSHOT_IN_PROGRESS": "refused", "CORRUPTION": "refused",
}

# Names of engine events.
EVENT_NAMES = (
    "engine.open.start", "engine.recovery.complete", "engine.recovery.failed", "snapshot.selected", "snapshot.temp.ignored", "snapshot.start",
    "snapshot.published", "snapshot.failed", "wal.segment.created", "wal.segment.sealed", "wal.segment.deleted", "wal.tail.truncated",
    "wal.interior.corruption", "storage.failure", "engine.faulted", "session.rejected", "session.dedup.hit", "engine.close.start",
    "engine.close.complete", "engine.close.deadline", "directory.unknown.file",
)

PUT, DELETE = 1, 2
COMMAND_FIXED_BYTES, SESSION_BYTES = 30, 66
SEGMENT_HEADER_BYTES, FRAME_HEADER_BYTES, SNAPSHOT_HEADER_BYTES = 32, 24, 44
ENTRY_OVERHEAD_BYTES = 16
MAX_ENTRIES_PER_MESSAGE, MAX_BYTES_PER_MESSAGE = 64, 1 << 20
RETAINED_SNAPSHOTS = 2

COMMAND_SCHEMA = "global_seq long, client long, request_seq long, kind int, key string, value string"
DELIVERY_SCHEMA = "pos long, client long, request_seq long, kind int, key string, value string"
ENTRY_SCHEMA = "g long, node int, idx long, term long, data string"


class ChangelogError(Exception):
    """An error with a code; the message never holds keys or values."""

    def __init__(self, code: str, detail: str = "", cause: Exception | None = None):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail, self.__cause__ = code, detail, cause


def code_of(error: BaseException | None) -> str:
    """The code of the error or of the nearest cause that has one."""
    while error is not None:
        if isinstance(error, ChangelogError):
            return error.code
        error = error.__cause__
    return "UNKNOWN"


def _filled(settings, defaults: dict):
    """Zero means the default."""
    return replace(settings, **{f.name: defaults[f.name] for f in fields(settings) if f.name in defaults and not getattr(settings, f.name)})


def _require(holds: bool, detail: str) -> None:
    if not holds:
        raise ChangelogError("INVALID_ARGUMENT", detail)


@dataclass(frozen=True)
class StorageSettings:
    max_key_bytes: int = 0
    max_value_bytes: int = 0
    max_keys: int = 0
    max_sessions: int = 0
    queue_capacity: int = 0
    segment_target_bytes: int = 0
    close_timeout_s: float = 0

    DEFAULTS = {"max_key_bytes": 1024, "max_value_bytes": 1 << 20, "max_keys": 1_000_000, "max_sessions": 10_000, "queue_capacity": 1024, "segment_target_bytes": 64 << 20, "close_timeout_s": 30}
    RANGES = {"max_key_bytes": (1, 1024), "max_value_bytes": (0, 1 << 20), "max_keys": (1, 1 << 24), "max_sessions": (1, 1 << 20), "queue_capacity": (1, 1 << 16), "segment_target_bytes": (1024, None), "close_timeout_s": (0, None)}

    def checked(self) -> StorageSettings:
        found = _filled(self, self.DEFAULTS)
        for name, (low, high) in self.RANGES.items():
            value = getattr(found, name)
            _require(value >= low and (high is None or value <= high), f"{name} {value} is out of range")
        return found

    @property
    def max_frame_payload(self) -> int:
        return COMMAND_FIXED_BYTES + 4 + self.max_key_bytes + self.max_value_bytes

    @property
    def max_snapshot_payload(self) -> int:
        return self.max_keys * (8 + self.max_key_bytes + self.max_value_bytes) + self.max_sessions * SESSION_BYTES


@dataclass(frozen=True)
class ConsensusSettings:
    node: int
    peers: tuple[int, ...]
    heartbeat_ticks: int = 0
    election_tick_min: int = 0
    election_tick_max: int = 0
    max_entries: int = 0
    max_bytes: int = 0
    seed: int = 0

    DEFAULTS = {"heartbeat_ticks": 1, "election_tick_min": 10, "election_tick_max": 20, "max_entries": MAX_ENTRIES_PER_MESSAGE, "max_bytes": MAX_BYTES_PER_MESSAGE}

    def checked(self) -> ConsensusSettings:
        found = _filled(self, self.DEFAULTS)
        _require(found.node != 0, "node 0 is reserved")
        _require(len(found.peers) > 0, "there are no peers")
        _require(0 not in found.peers, "node 0 is reserved")
        _require(len(set(found.peers)) == len(found.peers), "a peer appears twice")
        _require(found.node in found.peers, "the peers lack this node")
        _require(found.heartbeat_ticks >= 1, "heartbeat_ticks is below 1")
        _require(found.election_tick_min > found.heartbeat_ticks, "election_tick_min must exceed heartbeat_ticks")
        _require(found.election_tick_max > found.election_tick_min, "election_tick_max must exceed election_tick_min")
        _require(found.max_entries >= 1, "max_entries is below 1")
        _require(found.max_bytes >= 1, "max_bytes is below 1")
        return found

    @property
    def quorum(self) -> int:
        return len(self.peers) // 2 + 1
