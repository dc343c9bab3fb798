"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary file lies; ``spark.strandline.tokenizer`` names another.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words longer than this are encoded in pieces of this many characters, so that time stays linear.
LONGEST = 20_000


def vocabulary(spark: SparkSession) -> str:
    return spark.conf.get("spark.strandline.tokenizer", DEFAULT_VOCABULARY)


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("vocabularies", Path(path).resolve().parent / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(path).stem, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of a text; none for null. A text's tokens do not depend on its neighbours'."""
    if not text:
        return 0
    encode = encoding(path).encode_ordinary
    return len(encode(text))


def with_tokens(df: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
    """``df`` without its text column, with the text's size. White space alone has no size."""
    path = vocabulary(df.sparkSession)
    rest = [c for c in df.columns if c != text]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            n = [0 if not t or t.isspace() else count(t, path) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if i != at], pa.array(n, pa.int64())], names=[*rest, name])

    schema = df.drop(text).withColumn(name, F.lit(0).cast("bigint")).schema
    return df.select(*[F.col(f"`{c}`") for c in [*rest, text]]).mapInArrow(sizes, schema)
