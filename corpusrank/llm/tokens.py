"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.arrays import batches
from corpusrank.shared import spread

#: Folder of the vocabularies' Python module, and the vocabulary.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
_loaded: dict[str, object] = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The encoder, loaded once a process. The vocabulary is the file ``vocabulary`` below ``folder``, or of the installed module."""
    name = f"{folder}/{vocabulary}"
    if name not in _loaded:
        import tiktoken

        module = importlib.import_module("public_tokenizers")
        try:
            lines = open(name, "rb").readlines()
        except OSError:
            lines = open(module.path(vocabulary), "rb").readlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[name] = tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def token_sizes(docs: DataFrame, text: str, keep: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the tokens of the whole text; 0 of a null or empty one."""
    fields = docs.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches(it, "_text"):
            sizes = [len(encode(s)) if s else 0 for s in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    return spread(docs.select(*keep, F.col(text).cast("string").alias("_text"))).mapInArrow(run, ddl)
