"""Public vocabularies, read on the driver and sent to the workers once."""

from __future__ import annotations

import base64

from pyspark import Broadcast
from pyspark.sql import SparkSession

MOST_BYTES = 64 << 20


class Ranks:
    """A rank file (token and rank per line) with its split pattern, as codec and token sizes."""

    def __init__(self, raw: bytes, pattern: str):
        import tiktoken

        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=tokens, special_tokens={})
        self.sizes = [0] * (max(tokens.values()) + 1)
        for token, rank in tokens.items():
            self.sizes[rank] = len(token)


def broadcast_ranks(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """Send the rank file at ``path``; its size is checked, as vocabularies do not grow with the data."""
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} holds more than {MOST_BYTES} bytes: not a vocabulary")
    return spark.sparkContext.broadcast((raw, pattern))


def ranks_of(sent: Broadcast) -> Ranks:
    """The codec of a sent vocabulary, built once per worker and kept beside the broadcast."""
    if not hasattr(sent, "built"):
        sent.built = Ranks(*sent.value)
    return sent.built
