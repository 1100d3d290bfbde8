"""Secret redaction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SECRET_PATTERNS, SecretKind

# Text without which a default pattern cannot match; a cheap test before the regular expression.
_ANCHORS = {
    SecretKind.AWS_KEY: ("AKIA",),
    SecretKind.GITHUB_TOKEN: ("gh",),
    SecretKind.OPENAI_KEY: ("sk-",),
    SecretKind.ANTHROPIC_KEY: ("sk-ant-",),
    SecretKind.PRIVATE_IP: ("10.", "192.168.", "172."),
    SecretKind.USER_PATH: ("/Users/", "/home/"),
    SecretKind.EMAIL: ("@",),
}


def _may_match(text: Column, kind: SecretKind, pattern: str) -> Column:
    if (kind, pattern) not in SECRET_PATTERNS:
        return F.lit(True)
    first, *rest = (text.contains(a) for a in _ANCHORS[kind])
    for other in rest:
        first = first | other
    return first


def scrub(df: DataFrame, patterns: Sequence[tuple[SecretKind, str]] = SECRET_PATTERNS, content: str = "content") -> DataFrame:
    """``df`` with secrets replaced by ``[REDACTED:<label>]``, and ``redacted_kinds``.

    Patterns apply in order, each to what the ones before left; a kind is
    listed once, when any of its patterns changed the text. ``original_length``
    becomes the length in bytes before redaction. Null content stays null.
    """
    text = F.col(content)
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    for kind, pattern in patterns:
        state = _let(state, _step(kind, pattern))
    out = df.withColumns({"original_length": F.octet_length(text).cast("bigint"), "__scrubbed": state})
    return out.withColumns({content: F.col("__scrubbed.text"), "redacted_kinds": F.array_distinct("__scrubbed.kinds")}).drop("__scrubbed")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _step(kind: SecretKind, pattern: str) -> Callable[[Column], Column]:
    def redacted(s: Column) -> Column:
        text, kinds = s["text"], s["kinds"]
        new = F.when(_may_match(text, kind, pattern), F.regexp_replace(text, f"(?U){pattern}", f"[REDACTED:{kind.value}]")).otherwise(text)
        return _let(new, lambda t: F.struct(t.alias("text"), F.when(t != text, F.array_append(kinds, F.lit(kind.value))).otherwise(kinds).alias("kinds")))

    return redacted
