"""Validate snapshots as they land.

The reference validates one chosen snapshot at a time and saves the run. Here
the same batch suite runs inside ``foreachBatch`` over each micro-batch of
newly arrived snapshot files: every snapshot in the batch is validated against
the latest earlier snapshot (from the stored history or the same batch), and
the run is appended to the score, check-result and issue tables. No new
operator is involved.
"""

from veracity.streaming.arrivals import validate_arrivals

__all__ = ["validate_arrivals"]
