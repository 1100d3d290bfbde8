"""Which adapters exist and which one reads a file."""

from __future__ import annotations

from ..schema import AdapterKind
from .base import Adapter
from .chatgpt import ChatGptAdapter


def registry() -> list[Adapter]:
    """The adapters that can read; unsupported formats are not among them."""
    return [ChatGptAdapter()]


def pick_adapter(kind: AdapterKind | None, header: bytes) -> Adapter | None:
    """The registered adapter of ``kind`` without a look at the header, else the first that detects it."""
    for adapter in registry():
        if adapter.kind == kind if kind else adapter.detect(header):
            return adapter
    return None
