from .lineage import Grown, checkpoint_folder, cut_lineage, rewritten, store_partitioned
from .skew import lookup_join, only_value, spread
from .scan import Blocks, dyadic_blocks, positions

__all__ = [
    "Blocks",
    "Grown",
    "checkpoint_folder",
    "cut_lineage",
    "dyadic_blocks",
    "rewritten",
    "lookup_join",
    "only_value",
    "positions",
    "spread",
    "store_partitioned",
]
