"""Training configurations: rules that they have to meet, presets, and what follows from them."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TrainingConfig:
    """Sizes of a decoder and of its training. One that breaks a rule can't be made: the error names all broken ones."""

    name: str = "decoder"
    vocabulary: int = 500
    block: int = 256
    width: int = 384
    heads: int = 6
    layers: int = 6
    factor: int = 4
    dropout: float = 0.1
    rank_ratio: float = 1.0
    share: float = 0.9
    batch: int = 16
    accumulate: int = 1
    rate: float = 3e-4
    span: tuple[int, int] | None = None
    targets: tuple[str, ...] = ()
    complexity_head: bool = False
    experts: int = 0

    def __post_init__(self):
        if broken := [text for text, held in rules(self) if not held]:
            raise ValueError("; ".join(broken))

    @property
    def effective_batch(self) -> int:
        return self.batch * self.accumulate

    def merged(self, **changes) -> TrainingConfig:
        """A copy with other members; an unknown one is an error."""
        return dataclasses.replace(self, **changes)


def rules(config: TrainingConfig) -> list[tuple[str, bool]]:
    """Each rule and whether it is held."""
    low, high = config.span or (0, 1)
    return [
        ("vocabulary, block, layers and batch have to be above 0", min(config.vocabulary, config.block, config.layers, config.batch, config.accumulate) > 0),
        ("width has to be a multiple of heads", config.heads > 0 and config.width % config.heads == 0),
        ("dropout has to be from 0 to 1", 0.0 <= config.dropout <= 1.0),
        ("rank_ratio has to be above 0, up to 1", 0.0 < config.rank_ratio <= 1.0),
        ("share has to be between 0 and 1", 0.0 < config.share < 1.0),
        ("rate has to be above 0", config.rate > 0),
        ("span has to rise and end within block", low < high <= config.block),
        ("targets have to be of q, k, v, o and ffn", set(config.targets) <= {"q", "k", "v", "o", "ffn"}),
    ]


def column_rules(columns: list[str]) -> list[tuple[str, Column]]:
    """The same rules on columns of a table of configurations; members without a column, and null ones, have their default.

    ``span_low`` and ``span_high`` stand for the span, ``targets`` is an array.
    """
    usual = {x.name: x.default for x in dataclasses.fields(TrainingConfig)}
    had = {x.lower() for x in columns}
    of = lambda x: F.coalesce(F.col(x), F.lit(usual[x])) if x in had else F.lit(usual[x])
    sizes = F.least(*(of(x) for x in ("vocabulary", "block", "layers", "batch", "accumulate")))
    out = [
        (sizes > 0), (of("heads") > 0) & (F.pmod(of("width"), F.greatest(of("heads"), F.lit(1))) == 0), of("dropout").between(0.0, 1.0), (of("rank_ratio") > 0) & (of("rank_ratio") <= 1), (of("share") > 0) & (of("share") < 1), of("rate") > 0,
    ]
    span = [F.coalesce(F.col(x), F.lit(v)) if x in had else F.lit(v) for x, v in (("span_low", 0), ("span_high", 1))]
    out.append((span[0] < span[1]) & (span[1] <= of("block")))
    known = F.array(*map(F.lit, ("q", "k", "v", "o", "ffn")))
    out.append(F.size(F.array_except(F.coalesce(F.col("targets"), F.array()), known)) == 0 if "targets" in had else F.lit(True))
    return list(zip((text for text, _ in rules(TrainingConfig())), out, strict=True))


def judged(configs: DataFrame) -> DataFrame:
    """A table of configurations with ``broken``: the rules that each one breaks, in their order."""
    said = F.array(*(F.when(~held, F.lit(text)) for text, held in column_rules(configs.columns)))
    return configs.withColumn("broken", F.filter(said, lambda x: x.isNotNull()))


def validated(configs: DataFrame, key: str) -> DataFrame:
    """The configurations as they are; one that breaks a rule fails the job, which names it and all rules that it breaks."""
    found = judged(configs)
    text = F.concat(F.lit("configuration "), F.col(key).cast("string"), F.lit(": "), F.array_join("broken", "; "))
    # A key that is read is a key that was judged: the check can't be optimised away.
    checked = F.when(F.size("broken") == 0, F.col(key)).otherwise(F.raise_error(text).cast(configs.schema[key].dataType))
    return found.withColumn(key, checked).select(*(f"`{x}`" for x in configs.columns))


#: Sizes by name; a task's members stand over those of its size.
SIZES = {"small": {"width": 128, "heads": 4, "layers": 4, "block": 128}, "medium": {}, "large": {"width": 768, "heads": 12, "layers": 12, "block": 1024}}
TASKS = {
    "language_modeling": {"experts": 4, "targets": ("q", "v"), "rank_ratio": 0.5},
    "code_analysis": {"complexity_head": True, "experts": 4},
    "comparison": {"experts": 4, "targets": ("q", "v"), "rank_ratio": 0.5, "name": "comparison"},
    "standard": {"name": "standard"},
}


def preset(task: str = "language_modeling", size: str = "medium", **changes) -> TrainingConfig:
    """The configuration of a task and a size, with changes; unknown names are errors."""
    for name, known in ((task, TASKS), (size, SIZES)):
        if name not in known:
            raise ValueError(f"unknown preset: {name}")
    return TrainingConfig(**{**SIZES[size], **TASKS[task], **changes})
