"""Parameter counts and operations of a decoder model as Column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dimensions(hidden: Column, layers: Column, ffn: Column, vocab: Column, heads: Column, head_dim: Column, kv_heads: Column, rank: Column) -> dict[str, Column]:
    """decoder (matrix parameters), head, adapter (low-rank parameters) and width (of attention)."""
    q, kv = heads * head_dim, kv_heads * head_dim
    decoder = layers * (hidden * q * 2 + hidden * kv * 2 + hidden * ffn * 3)
    adapter = layers * rank * ((hidden + q) * 2 + (hidden + kv) * 2 + (hidden + ffn) * 3)
    return {"decoder": decoder, "head": hidden * vocab, "adapter": adapter, "width": q}


def forward_operations(decoder: Column, head: Column, layers: Column, width: Column, length: Column) -> Column:
    """Operations of a forward pass for one token at a mean position of half the length."""
    return (decoder + head) * F.lit(2.0) + layers * width * length * F.lit(2.0)


def update_operations(forward: Column, adapter: Column) -> tuple[Column, Column]:
    """(model, hardware) operations of an adapter update for one token: backward through the frozen weights, and a recomputed forward pass."""
    extra = adapter * F.lit(2.0)
    model = forward * 2 + extra * 3
    return model, model + forward + extra
