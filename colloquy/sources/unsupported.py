"""Formats that are named but cannot be read yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import AdapterKind
from .base import Adapter


class _Unsupported(Adapter):
    def detect(self, header: bytes) -> bool:
        return False

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        raise NotImplementedError(f"the {self.kind.value} adapter is not implemented yet")


class ClaudeWebAdapter(_Unsupported):
    kind = AdapterKind.CLAUDE_WEB


class GeminiAdapter(_Unsupported):
    kind = AdapterKind.GEMINI


class ClaudeCodeAdapter(_Unsupported):
    kind = AdapterKind.CLAUDE_CODE
