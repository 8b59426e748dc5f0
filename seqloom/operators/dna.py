"""Fast path for DNA: canonical rolling hashes by numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from seqloom.functions.hashing import nucleotide_hashes


def nucleotide_sets(seqs: DataFrame, k: int, scale: int = 1, canonical: bool = True, keep: tuple[str, ...] = ("ref_id",), seq_col: str = "seq", distinct: bool = True) -> DataFrame:
    """keep columns, n_kmers and kmers (signed longs) of each DNA sequence; the unsigned smallest 1/scale of hashes stay."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType

    rows = seqs.select(*keep, seq_col)
    out = StructType([*(rows.schema[c] for c in keep), StructField("n_kmers", LongType()), StructField("kmers", ArrayType(LongType()))])
    arrow = to_arrow_schema(out)
    top = np.uint64(0xFFFFFFFFFFFFFFFF if scale <= 1 else int(float(0xFFFFFFFFFFFFFFFF) / scale))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for s in batch[seq_col].to_pylist():
                _, h = nucleotide_hashes((s or "").encode(), k, canonical)
                h = h[h <= top]
                found.append((np.unique(h) if distinct else h).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(h) for h in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array([len(h) for h in found], pa.int64()), lists.cast(arrow.field("kmers").type)], schema=arrow)

    return rows.mapInArrow(run, out)
