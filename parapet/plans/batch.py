"""One batch from raw conversations to the stored table, its summary and an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parapet.functions.scoring import Scorer, no_score
from parapet.lexicon import TOXICITY_THRESHOLD
from parapet.operators.audit import audit
from parapet.operators.normalize import fill_missing, union_all
from parapet.sources.readers import read_audit_table
from parapet.sources.writers import append_batch, export_csv


def audit_batch(
    sources: list[DataFrame],
    table: str,
    batch: int,
    batch_time: str,
    tags: list[str] | None = None,
    export: str | None = None,
    toxicity: Scorer = no_score,
    sentiment: Scorer = no_score,
    threshold: float = TOXICITY_THRESHOLD,
    redact_pii: bool = True,
    **defaults: str | None,
) -> dict[str, int]:
    """Union, fill defaults, audit, append as batch ``batch``, and export the whole table.

    Gives ``processed`` and ``flagged``, counted while the rows are written, without
    another reading. Sources are conversations as the readers give them. A repeated batch
    replaces itself; ``export`` is a new CSV folder.
    """
    rows = fill_missing(union_all(*sources), tags, **defaults)
    counts = Observation(f"batch {batch}")
    audited = audit(rows, toxicity, sentiment, threshold, redact_pii, batch_time).observe(
        counts, F.count("*").alias("processed"), F.count_if("flagged").alias("flagged")
    )
    append_batch(audited, table, batch)
    if export:
        export_csv(read_audit_table(rows.sparkSession, table), export)
    return dict(counts.get)
