"""Export formats."""

from .base import Adapter
from .chatgpt import ChatGptAdapter
from .jsonl import read_jsonl
from .registry import pick_adapter, registry
from .unsupported import ClaudeCodeAdapter, ClaudeWebAdapter, GeminiAdapter

__all__ = ["Adapter", "ChatGptAdapter", "ClaudeCodeAdapter", "ClaudeWebAdapter", "GeminiAdapter", "pick_adapter", "read_jsonl", "registry"]
