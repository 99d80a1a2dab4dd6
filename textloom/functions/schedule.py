"""Learning rates and parameter counts as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(kind: str, step: Column, total: int, rate: float, least: float = 1e-6, last: float = 0.1) -> Column:
    """The rate at a step: ``cosine`` falls to ``least``, ``linear`` to ``last`` times the rate, ``constant`` stays."""
    if kind == "cosine":
        return F.lit(least) + F.lit(rate - least) * (1 + F.cos(F.lit(3.141592653589793) * step / F.lit(float(total)))) / 2
    if kind == "linear":
        return F.lit(rate) * (1 + F.lit(last - 1.0) * F.least(step, F.lit(total)) / F.lit(float(total)))
    if kind == "constant":
        return F.lit(rate) + 0 * step
    raise ValueError(f"no such schedule: {kind}")


def transformer_parameters(vocabulary: Column, width: Column, layers: Column, factor: int = 4) -> Column:
    """Weights of a decoder: embeddings and head, then attention, feed-forward and norms of each layer."""
    attention, forward, norms = 4 * width * width, 2 * factor * width * width + (factor + 1) * width, 4 * width
    return 2 * vocabulary * width + layers * (attention + forward + norms) + 2 * width


def tied_parameters(vocabulary: Column, block: Column, width: Column, layers: Column, inner: Column, rotary: bool = False) -> Column:
    """Weights of a decoder whose head is its embedding: embeddings (places too, unless they are rotary), two norms, attention and feed-forward a layer, a last norm."""
    layer = 4 * width + 4 * width * width + 2 * width * inner
    return vocabulary * width + (F.lit(0) if rotary else block * width) + layer * layers + 2 * width


def adapted_parameters(base: Column, width: Column, layers: Column, matrices: int, rank: int, experts: int, expert_width: int, classifier: bool = True) -> Column:
    """``base`` with low-rank factors for some matrices a layer, expert vectors, and a classifier that chooses between them."""
    return base + layers * matrices * 2 * rank * width + experts * expert_width + (width * experts if classifier else F.lit(0))


def estimated_parameters(vocabulary: Column, block: Column, width: Column, layers: Column, factor: int = 4, rank_ratio: float | None = None, classes: int = 0) -> Column:
    """A rough count: embeddings, attention and feed-forward (fewer by half of what a rank ratio saves), a head, a head for classes."""
    blocks = (4 * width * width + 2 * factor * width * width) * layers
    if rank_ratio is not None:
        blocks = F.floor(blocks * F.lit(1 - (1 - rank_ratio) * 0.5))
    return 2 * vocabulary * width + block * width + blocks + width * classes


def perplexity(loss: Column) -> Column:
    """exp of the mean loss; 0 where there is no loss."""
    return F.coalesce(F.exp(F.avg(loss)), F.lit(0.0))
