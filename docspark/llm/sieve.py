"""A broadcast bitmap of ids that spares tasks the rows that no later join will want."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meeting import Bitmap, bitmap


def sieved(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, object]:
    """docs with a hash of the id (slot), and the broadcast bitmap of the ids' hashes. All of ids pass, and few others."""
    slot = F.xxhash64("id")
    return docs.withColumn("slot", slot), bitmap(ids.select(slot.alias("slot")), "slot")


def passing(batch: pa.RecordBatch, ids: Bitmap) -> pa.RecordBatch:
    return batch.filter(pa.array(ids.passes(batch["slot"].to_numpy().view(np.uint64))))
