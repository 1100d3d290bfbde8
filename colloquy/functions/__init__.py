"""Column functions; all of them stay in built-in expressions."""

from .numbers import hits_norm, recency, signal_score, type_weight
from .text import blank, content_hash, jaccard, slugify, tokens, trim_end
from .time import epoch_to_timestamp, rfc3339

__all__ = ["blank", "content_hash", "epoch_to_timestamp", "hits_norm", "jaccard", "recency", "rfc3339", "signal_score", "slugify", "tokens", "trim_end", "type_weight"]
