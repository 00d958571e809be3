"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where they provably agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.llm import bpe, flat

#: Characters of a chunk and of the overlap of two; a text of more bytes than a chunk has characters is chunked.
CHUNK, OVERLAP = 32_768, 512
STEP_BYTES = 4 << 20


def count_tokens(docs: DataFrame, tokenizer: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens): UTF-8 bytes and tokens of each whole text, as the `tokenizers` library gives them.

    One row for each row, no shuffle. Null and empty texts have 0 of both. tokenizer: path of a byte-level BPE file
    that every executor can read; the default is the public 50k vocabulary. Memory is bounded by a few MB of text or
    one text; a text beyond `chunk` is never encoded at once.
    """
    path = tokenizer or bpe.default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            for part in flat.steps(batch, "text", STEP_BYTES):
                _, offsets = flat.flatten(part.column("text"))
                size = np.diff(offsets)
                n = np.zeros(part.num_rows, np.int64)
                short = size <= chunk
                _, at = model.encode(part.column("text").filter(pa.array(short)))
                n[short] = np.diff(at)
                for i in np.flatnonzero(~short).tolist():
                    n[i] = sum(len(ids) for _, ids in model.splices(part.column("text")[i].as_py(), chunk, overlap))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
