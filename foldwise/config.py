"""Experiment constants and the frozen run configuration."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# --- fixed values (must equal the scored task's definitions) ---------------
# Target columns, in this order everywhere.
TARGETS = ["cohesion", "syntax", "vocabulary", "phraseology", "grammar", "conventions"]
# Seeds of the three cross-validation patterns, number of folds, trained folds.
SEEDS = [42, 43, 44]
N_FOLDS = 5
TRAIN_FOLDS = [0, 1, 2, 3, 4]
# Prefix inserted before the text in the regression-token dataset variant
# (leading and trailing blank are part of it).
REG_TOKEN_PREFIX = " cohesion syntax vocabulary phraseology grammar conventions [SEP] "
# Paragraph marker variant: every blank line becomes this separator.
PARAGRAPH_BREAK = "\n\n"
PARAGRAPH_MARKER = " | "
# Per-target weights of the weighted smooth-L1 loss, in TARGETS order.
SMOOTH_L1_WEIGHTS = [0.21, 0.16, 0.10, 0.16, 0.21, 0.16]
# Constant prediction written into the sample OOF table.
SAMPLE_OOF_VALUE = 3.0
# Run names accepted by the model registry: full match of this pattern.
RUN_NAME_PATTERN = "[a-zA-Z0-9-]+"
# Debug mode: rows per split and folds used.
DEBUG_ROWS = 300
DEBUG_FOLDS = [0, 1]
# Training defaults.
BATCH_SIZE = 4
EPOCHS = 4
MAX_TOKENS = 2048
VAL_CHECK_INTERVAL = 125
# Special tokens of the whitespace tokenizer.
CLS_TOKEN = "[CLS]"
SEP_TOKEN = "[SEP]"
PAD_TOKEN = "[PAD]"
# ---------------------------------------------------------------------------

DATA_VERSIONS = ("vanilla", "paragraph", "reg_token")
POOLINGS = ("mean", "gem_cls", "reg_token")
LOSSES = ("smooth_l1", "weighted_smooth_l1", "rmse_loss", "squared")


@dataclass(frozen=True)
class RunConfig:
    """Frozen replacement for the mutable config classes of a run."""

    run_name: str = "baseline"
    model_name: str = "base"   # model variant; the same jobs serve every variant
    data_version: str = "vanilla"
    pooling: str = "mean"
    loss: str = "smooth_l1"
    seeds: tuple = tuple(SEEDS)
    n_folds: int = N_FOLDS
    train_folds: tuple = tuple(TRAIN_FOLDS)
    batch_size: int = BATCH_SIZE
    epochs: int = EPOCHS
    max_tokens: int = MAX_TOKENS
    smooth_l1_beta: float = 1.0
    smooth_l1_weights: tuple = tuple(SMOOTH_L1_WEIGHTS)
    n_features: int = 128
    ridge_lambda: float = 1.0
    prior_lambda: float = 10.0
    # penalties of the pretraining fit and weights of its prior to choose from
    penalties: tuple = (0.1, 1.0, 10.0, 100.0)
    prior_weights: tuple = (1.0, 10.0, 100.0, 1000.0)
    # iterations of a fit whose loss is not squared, and the change that ends it
    max_steps: int = 25
    tolerance: float = 1e-6
    debug: bool = False
    debug_rows: int = DEBUG_ROWS
    targets: tuple = field(default_factory=lambda: tuple(TARGETS))

    def __post_init__(self):
        if self.data_version not in DATA_VERSIONS:
            raise ValueError(f"unknown data_version {self.data_version!r}")
        if self.pooling not in POOLINGS:
            raise ValueError(f"unknown pooling {self.pooling!r}")
        if self.loss not in LOSSES:
            raise ValueError(f"unknown loss {self.loss!r}")
        # Position-slice pooling reads one vector per target word, which only
        # exists in the prefixed dataset; the two settings go together.
        if (self.data_version == "reg_token") != (self.pooling == "reg_token"):
            raise ValueError("data_version 'reg_token' and pooling 'reg_token' must be used together")
        if self.debug and self.train_folds == tuple(TRAIN_FOLDS):
            object.__setattr__(self, "train_folds", tuple(DEBUG_FOLDS))

    @property
    def val_check_interval(self) -> int:
        if self.batch_size == 1:
            return 500
        if self.debug:
            return self.debug_rows // 8
        return VAL_CHECK_INTERVAL

    def as_params(self) -> dict:
        """Flat key -> string record of the run (hyper-parameter log)."""
        out = {}
        for k, v in asdict(self).items():
            out[k] = ",".join(map(str, v)) if isinstance(v, (tuple, list)) else str(v)
        out["val_check_interval"] = str(self.val_check_interval)
        return out
