"""Streaming operators.

The analysed reference contains no streaming, watermark, event-time window or stateful
operator: visits arrive with a ready-made ``visit_id`` and every stage is a bounded
batch.  No streaming operator is therefore provided; the batch operators accept any
DataFrame, including one produced by ``foreachBatch`` of a Structured Streaming query.
"""
