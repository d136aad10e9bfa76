"""Streaming.

The analysed workload reads only whole files; it has no unbounded source, event-time
window, watermark or state, so no streaming query is registered. The batch operators are
plain DataFrame transformations: the stateless ones (scalar functions, projections,
direction roll-up per micro-batch) apply unchanged to a ``readStream`` DataFrame, and the
series operators are batch-only by design (they order whole series).
"""
