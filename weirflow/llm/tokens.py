"""Token ids by a public byte-level BPE vocabulary; the file's path is a parameter.

The driver reads the file and sends it to the executors, which needn't have it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import tiktoken
from pyspark.sql import SparkSession

from weirflow.llm.scratch import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging, a fixed value of that tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of so many characters, all white space or none of it, is cut before it is encoded: the pattern's engine
#: runs out of stack in very long ones.
RUN = 4096
_LONG_RUN = re.compile(rf"\s{{{RUN}}}|\S{{{RUN}}}")


def send(spark: SparkSession, path: str = VOCABULARY):
    """A broadcast of the vocabulary file (about 1 MB); opens as an encoding with encoding()."""
    small_batches(spark)
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoding(content: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def end_of_text(enc: tiktoken.Encoding) -> int:
    """The id after the vocabulary's last one: free there, and the end of a text here."""
    return enc.max_token_value + 1


def parts(text: str) -> Iterator[str]:
    """The text in parts that are encoded one by one; joined, they are the text."""
    at = 0
    if len(text) >= RUN:
        for run in _LONG_RUN.finditer(text):
            yield text[at : run.end()]
            at = run.end()
    yield text[at:]


def count(enc: tiktoken.Encoding, text: str) -> int:
    return sum(len(enc.encode_ordinary(part)) for part in parts(text))


def ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    found = [enc.encode_to_numpy(part, disallowed_special=()) for part in parts(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)
