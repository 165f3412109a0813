"""Token ids of a whole corpus by a public tokenizer.

The vocabulary is a local rank file for the tiktoken library; its path is a
parameter, and each Python worker reads it once. Token ids are those of the
text as it stands, without special tokens: the string of a special token inside a
text is ordinary text. Long texts are cut at safe boundaries, between a
character that is no white space and white space; no pattern match spans such a
place, so the ids are the same. Ids are turned back into text through their raw
bytes, which are joined before they are decoded.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts of more characters are cut.
LONG = 100_000


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The encoding of a rank file, by default byte_bpe_50k; kept per process."""
    import public_tokenizers
    import tiktoken

    with open(path or rank_file(), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long: int = LONG) -> list[str]:
    """``text`` in pieces of about ``long`` characters, cut only at safe boundaries."""
    out, at = [], 0
    safe = re.compile(r"(?<=\S)(?=\s)")
    while len(text) - at > long:
        found = safe.search(text, at + long)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def ids_of(text: str | None, encoding, long: int = LONG) -> list[int]:
    if not text:
        return []
    if len(text) <= long:
        return encoding.encode_ordinary(text)
    return [i for part in parts(text, long) for i in encoding.encode_ordinary(part)]


def encode(df: DataFrame, id_col: str, text_col: str, out: str = "ids", path: str | None = None, long: int = LONG) -> DataFrame:
    """``id_col, out``: one list of token ids for each row, empty for empty and null texts.

    Every row of the input gives one row, repeated ids too; a null id stays null;
    other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path)
        for batch in batches:
            ids = [ids_of(t, encoding, long) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, out])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>")


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of token ids."""
    return b"".join(encoder(path).decode_tokens_bytes(ids)).decode("utf-8")
