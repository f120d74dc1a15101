"""Token counts: Arrow functions that return lengths only.

Texts over ``PART_CHARS`` characters are split at safe boundaries, before a run
of spaces, so that no call holds much more of a long text than of a short one.
Counts of parts add up exactly.  The texts and parts of an Arrow batch go to the
library in calls of about ``CALL_BYTES`` bytes each; only their lengths come back.

Edge cases: null counts as empty, with 0 bytes and 0 tokens; special strings in
a text are ordinary text, as the library has it; a very long text without spaces
has no safe boundary and is one part; repeated rows get equal counts; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.vocabulary import MARK, balanced, model_path, processor
from joinwright.llm.worker import tidy

LIMIT = 4096
#: Bytes of text that go to the library in one call.
CALL_BYTES = 1 << 18
#: Characters after which a text is cut at the next safe boundary.
PART_CHARS = 1 << 16

#: Before a run of spaces; the library reads the space mark as a space.
_BOUNDARY = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")


def safe_parts(text: str, limit: int = PART_CHARS) -> list[str]:
    """Parts of a text of ``limit`` characters or little more.

    A part but the first lacks the space it starts with, which the library adds.
    """
    out, at = [], 0
    while len(text) - at > limit:
        cut = _BOUNDARY.search(text, at + limit)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def count_tokens(texts: list[str | None], path: str, call_bytes: int = CALL_BYTES, part_chars: int = PART_CHARS) -> list[int]:
    """Tokens of each text."""
    model = processor(path)
    pieces, owners, out = [], [], [0] * len(texts)
    for i, text in enumerate(texts):
        if text:
            split = safe_parts(text, part_chars)
            pieces += split
            owners += [i] * len(split)
    for a, b in balanced((len(p.encode()) for p in pieces), call_bytes):
        for k, ids in zip(range(a, b), model.encode(pieces[a:b], num_threads=1), strict=True):
            # an empty part is the lone space that ended a text
            out[owners[k]] += len(ids) or 1
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; ``path`` names the model file."""
    path = path or model_path()

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            counts: list[int] = []
            for a, b in balanced(sizes, 16 * CALL_BYTES):
                counts += count_tokens(batch.column(2).slice(a, b - a).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(tidy(run, "processor"), "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
