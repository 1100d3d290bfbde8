"""The canonical message row, the raw export and the closed vocabularies."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Role(str, Enum):
    USER = "user"
    ASSISTANT = "assistant"
    SYSTEM = "system"
    TOOL = "tool"


class AdapterKind(str, Enum):
    CHATGPT = "chatgpt"
    CLAUDE_WEB = "claude_web"
    GEMINI = "gemini"
    CLAUDE_CODE = "claude_code"


class OutputFormat(str, Enum):
    JSONL = "jsonl"
    MARKDOWN = "markdown"
    BOTH = "both"

    @classmethod
    def parse(cls, text: str) -> OutputFormat:
        names = {"jsonl": cls.JSONL, "json": cls.JSONL, "markdown": cls.MARKDOWN, "md": cls.MARKDOWN, "both": cls.BOTH, "all": cls.BOTH}
        try:
            return names[text.lower()]
        except KeyError:
            raise ValueError(f"unknown format: {text}") from None


MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("original_length", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("thread_title", T.StringType()),
        T.StructField("project_hint", T.StringType()),
        T.StructField("content_hash", T.DecimalType(20, 0)),
        T.StructField("hits", T.LongType()),
        T.StructField("signal_score", T.FloatType()),
    ]
)
MESSAGE_COLUMNS = MESSAGE.fieldNames()

#: One conversation of the raw export; message parts are of any JSON type.
CONVERSATION_DDL = (
    "struct<id: string, title: string, create_time: double, current_node: string, "
    "mapping: map<string, struct<message: struct<id: string, author: struct<role: string>, "
    "content: struct<parts: array<variant>>, create_time: double>, parent: string>>>"
)
