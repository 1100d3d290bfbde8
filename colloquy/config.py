"""Pipeline settings and the secret patterns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from .schema import OutputFormat


class SecretKind(str, Enum):
    """The closed set of redaction labels."""

    AWS_KEY = "aws_key"
    GITHUB_TOKEN = "github_token"
    OPENAI_KEY = "openai_key"
    ANTHROPIC_KEY = "anthropic_key"
    PRIVATE_IP = "private_ip"
    USER_PATH = "user_path"
    EMAIL = "email"


# The default patterns, in the order in which they apply.
SECRET_PATTERNS: tuple[tuple[SecretKind, str], ...] = (
    (SecretKind.AWS_KEY, r"AKIA[0-9A-Z]{16}"),
    (SecretKind.GITHUB_TOKEN, r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    (SecretKind.OPENAI_KEY, r"sk-[A-Za-z0-9]{48}"),
    (SecretKind.ANTHROPIC_KEY, r"sk-ant-[A-Za-z0-9\-_]{40,}"),
    (SecretKind.PRIVATE_IP, r"(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})"),
    (SecretKind.USER_PATH, r"/(?:Users|home)/[^/\s]+"),
    (SecretKind.EMAIL, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
)


@dataclass(frozen=True)
class PipelineConfig:
    """Any doubles are accepted as thresholds; see the operators for the edges.

    ``output_format`` and ``dry_run`` are carried for callers; the pipeline
    itself does not read them.
    """

    dedup_threshold: float = 0.85
    signal_min: float = 0.2
    max_thread_age_days: int = 1095
    secret_patterns: tuple[tuple[SecretKind, str], ...] = field(default=SECRET_PATTERNS)
    output_format: OutputFormat = OutputFormat.JSONL
    dry_run: bool = False

    @classmethod
    def with_safe_defaults(cls, **changes) -> PipelineConfig:
        return replace(cls(), **changes)
