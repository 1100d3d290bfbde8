"""Nested conversation exports: parsing, the active branch of each tree, and rows.

A conversation is a map of nodes with parent pointers. Its active branch is
found by climbing from the current node inside one higher-order expression,
so no row leaves its partition and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blank, content_hash, epoch_to_timestamp, slugify
from ..operators.signals import ranked
from ..schema import CONVERSATION_DDL, MESSAGE_COLUMNS, AdapterKind, Role
from ..storage import stage
from .base import Adapter

#: Places in a conversation that fit below the conversation's number in ``seq``.
SEQ_BITS = 24
# What the start of an export must contain, one of them.
MARKERS = (b'"mapping"', b'"conversations"')


def active_branch(mapping: Column, current: Column) -> Column:
    """Node ids from the root down to ``current``.

    Without a current node the climb starts at a parentless node (the smallest
    key of several), which is all it reaches. It ends at a node already seen
    or not in the map; the latter is not part of the branch.
    """
    root = F.array_min(F.filter(F.map_keys(mapping), lambda k: mapping[k]["parent"].isNull()))
    start = F.struct(F.coalesce(current, root).alias("at"), F.array().cast("array<string>").alias("path"))

    def climb(acc: Column, _: Column) -> Column:
        here = acc["at"]
        open_ = here.isNotNull() & F.map_contains_key(mapping, F.coalesce(here, F.lit(""))) & ~F.array_contains(acc["path"], F.coalesce(here, F.lit("")))
        return F.struct(F.when(open_, mapping[here]["parent"]).alias("at"), F.when(open_, F.concat(F.array(here), acc["path"])).otherwise(acc["path"]).alias("path"))

    steps = F.sequence(F.lit(1), F.greatest(F.size(mapping), F.lit(1)))
    return F.when(F.size(mapping) > 0, F.aggregate(steps, start, climb)["path"]).otherwise(F.array().cast("array<string>"))


def text_of(parts: Column) -> Column:
    """The string parts joined by line feeds; parts of other types are left out."""
    strings = F.filter(parts, lambda p: F.schema_of_variant(p) == "STRING")
    return F.array_join(F.transform(strings, lambda p: p.cast("string")), "\n")


def known_role(role: Column) -> Column:
    """Whether a role is one of the four that are kept."""
    return role.isin([r.value for r in Role])


def _required(value: Column, what: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"export: {what} is missing"))).otherwise(value)


def parse_conversations(texts: DataFrame, column: str = "value") -> DataFrame:
    """(conv_idx, conv) for each element of a JSON array of conversations; anything malformed fails the query."""
    checked = F.when(F.col(column).rlike(r"^\s*\["), F.col(column)).otherwise(F.raise_error(F.lit("export: a JSON array of conversations is expected")))
    return texts.select(F.posexplode(F.from_json(checked, f"array<{CONVERSATION_DDL}>", {"mode": "FAILFAST"})).alias("conv_idx", "conv"))


def messages(conversations: DataFrame) -> DataFrame:
    """Message rows with ``seq`` from conversations(conv_idx, conv).

    Left out: nodes without message, roles other than the four known ones,
    blank texts and times that no timestamp can hold.
    """
    mapping = F.coalesce(F.col("conv.mapping"), F.create_map().cast("map<string, struct<message: struct<id: string, author: struct<role: string>, content: struct<parts: array<variant>>, create_time: double>, parent: string>>"))
    walked = conversations.select(
        "conv_idx",
        _required(F.col("conv.id"), "a conversation's id").alias("conv_id"),
        _required(F.col("conv.title"), "a conversation's title").alias("title"),
        _required(F.col("conv.create_time"), "a conversation's create_time").alias("conv_time"),
        mapping.alias("mapping"),
        F.posexplode(active_branch(mapping, F.col("conv.current_node"))).alias("place", "node"),
    )
    found = walked.select("conv_idx", "place", "conv_id", "title", "conv_time", F.col("mapping")[F.col("node")]["message"].alias("m")).where(F.col("m").isNotNull())
    rows = found.select(
        (F.shiftleft(F.col("conv_idx").cast("bigint"), SEQ_BITS) + F.col("place")).alias("seq"),
        F.concat("conv_id", F.lit(":"), _required(F.col("m.id"), "a message's id")).alias("id"),
        _required(F.col("m.author.role"), "a message's role").alias("role"),
        text_of(F.coalesce(_required(F.col("m.content"), "a message's content")["parts"], F.array().cast("array<variant>"))).alias("content"),
        epoch_to_timestamp(F.col("m.create_time"), F.col("conv_time")).alias("created_at"),
        F.col("conv_id").alias("thread_id"),
        F.col("title").alias("thread_title"),
    )
    rows = rows.where(known_role(F.col("role"))).where(~blank(F.col("content"))).where(F.col("created_at").isNotNull())
    return rows.withColumns(
        {
            "source": F.lit(AdapterKind.CHATGPT.value),
            "original_length": F.lit(0).cast("bigint"),
            "project_hint": slugify(F.col("thread_title")),
            "content_hash": content_hash(F.col("content")),  # of the text before any redaction
            "hits": F.lit(1).cast("bigint"),
            "signal_score": F.lit(0.0).cast("float"),
        }
    ).select(*MESSAGE_COLUMNS, "seq")


def detected(text: Column) -> Column:
    """Detection as an expression over texts that are valid as they are."""
    first, *rest = (text.contains(m.decode()) for m in MARKERS)
    for other in rest:
        first = first | other
    return first


class ChatGptAdapter(Adapter):
    kind = AdapterKind.CHATGPT

    def detect(self, header: bytes) -> bool:
        """A header that a cut through a character makes invalid is not detected."""
        try:
            header.decode()
        except UnicodeDecodeError:
            return False
        return any(m in header for m in MARKERS)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """One export file, parsed as a whole in one task."""
        return messages(parse_conversations(spark.read.text(path, wholetext=True)))

    def read_many(self, spark: SparkSession, path: str) -> DataFrame:
        """A folder of export files, or large ones: an array element a row, in file order.

        ``conv_idx`` is the place in the order of (file, element), found by
        ranges, so neither the files nor their counts meet in one task. A file
        that holds one conversation, not in an array, counts as one element.
        """
        schema = spark.createDataFrame([], f"conv {CONVERSATION_DDL}").schema["conv"].dataType
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
        placed = rows.select(F.struct(*schema.fieldNames()).alias("conv"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
        numbered = ranked(stage(placed, "conversations"), F.col("file"), F.col("at"), name="conv_idx")
        return messages(numbered.select((F.col("conv_idx") - 1).alias("conv_idx"), "conv"))
