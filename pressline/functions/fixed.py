"""Fixed values that must equal the reference's for results to match.

They are stated plainly and together; everything larger is built from a rule
(see ``pressline.functions.bytes_``).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly)
# ---------------------------------------------------------------------------

# Special tokens in declared order: name, literal text, id.
SPECIAL_TOKENS = [
    ("pad_token", "<|pad_token|>", 0),
    ("doc_begin_token", "<|begin_of_doc|>", 1),
    ("doc_end_token", "<|end_of_doc|>", 2),
    ("unk_token", "<|unk|>", 3),
]
PAD_ID = 0
BOD_ID = 1
EOD_ID = 2
UNK_ID = 3
N_SPECIAL = 4

# Byte-level pre-tokenizer pattern (the public byte-level BPE pattern); ``(?U)``
# makes Java's \s and \p classes Unicode-aware.
PRETOKEN_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# Pre-training stage order and the terminal state.
STAGES = ["initial_stage", "lc_stage", "annealing_stage"]
STAGE_ORDER = ["initial_stage", "lc_stage", "annealing_stage", "complete"]

# Validation / checkpoint cadence (updates); overfit profile uses the second.
CADENCE = 200
CADENCE_OVERFIT = 50

# EMA smoothing factor for the step-time monitor.
EMA_ALPHA = 0.1

# Safe micro-batch factor.
SAFE_BATCH_FACTOR = 0.85

# Benchmarks by stage: task|n_shot list for annealing and complete.
EVAL_TASK_SPEC = "gsm8k|5,math|4"
EVAL_STAGES_WITH_TASKS = ["annealing_stage", "complete"]

# Number of long-context sequence-length milestones.
N_MILESTONES = 6

# Smoothing window bounds for run-log plots.
SMOOTH_MAX_WINDOW = 100
SMOOTH_MIN_WINDOW = 2
SMOOTH_DIVISOR = 10

# Preference strengths kept for reward data.
PREF_KEEP = ["significantly better", "better"]
PREF_LEVELS = ["significantly better", "better", "slightly better", "negligibly better or unsure"]

# Schedule profiles (full-scale and scaled-down configuration values).
PROFILES = {
    "full": dict(
        vocab_size=128_000, dtype="uint32",
        steps=1_200_000, warmup_steps=8_000, peak_lr=8e-5, decay_lr_to=8e-7,
        initial_tokens=15_600_000_000_000, initial_val_tokens=None,
        initial_seq_len=4_096, initial_global_batch_tokens=4_000_000,
        first_increase_at=252_000_000, second_increase_at=2_870_000_000_000,
        lc_tokens=800_000_000_000, lc_val_tokens=None, lc_seq_len=8_192,
        lc_increase_to=128_000,
        anneal_tokens=40_000_000, anneal_val_tokens=None, anneal_seq_len=128_000,
        anneal_decay_to=0.0, max_eval_samples=None,
    ),
    "scaled": dict(
        vocab_size=64_000, dtype="uint16",
        steps=11_522, warmup_steps=500, peak_lr=1e-4, decay_lr_to=8e-7,
        initial_tokens=9_500_000_000, initial_val_tokens=10_240_000,
        initial_seq_len=2_048, initial_global_batch_tokens=250_000,
        first_increase_at=161_000_000, second_increase_at=1_700_000_000,
        lc_tokens=490_000_000, lc_val_tokens=2_048_000, lc_seq_len=4_096,
        lc_increase_to=8_192,
        anneal_tokens=24_000_000, anneal_val_tokens=1_024_000, anneal_seq_len=8_192,
        anneal_decay_to=0.0, max_eval_samples=50,
    ),
}

# Overfit-profile overrides applied on top of a base profile.
OVERFIT_OVERRIDES = dict(
    d_model=128, num_layers=2, attn_heads=4, num_kv_heads=4, d_ff=512,
    max_eval_samples=5, steps=100, warmup_steps=10,
    initial_global_batch_tokens=256, initial_seq_len=128,
    first_increase_at=5_000, second_increase_at=8_000,
    initial_tokens=20_000, initial_val_tokens=5_000,
    peak_lr=1e-3, decay_lr_to=1e-4,
    lc_seq_len=512, lc_increase_to=1024, lc_tokens=10_000, lc_val_tokens=2_000,
    anneal_tokens=7_000, anneal_val_tokens=1_000, anneal_seq_len=1024,
)

# Run-name prefix used for overfit artefacts (one lower-case form).
OVERFIT_PREFIX = "overfit_"

# Checkpoint directory part.
CHPT_DIR_PART = "num_grad_updates_"

# Labels of the stage boundaries on a run's chart.
BOUNDARY_LABELS = {
    "warmup": "→ Warmup End & Initial stage start",
    "lc_stage": "→ lc_stage Start",
    "annealing_stage": "→ annealing_stage Start",
    "complete": "→ annealing_stage End",
}

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------
