"""Names, fixed values and schemas of the essay data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the workflow being re-built, for equal results.
# ---------------------------------------------------------------------------
TRAITS = [
    "task_1",
    "content_1",
    "content_2",
    "content_3",
    "organization_1",
    "organization_2",
    "expression_1",
    "expression_2",
]
PROMPT_COL = "question@prompt"
TEXT_COL = "answer@text"
SENTENCE_SEP = "#@문장구분#"
LABEL_SEP = "###"            # sentence prefix "<prompt>###<sentence>" (labeled embedding)
FINE_TUNE_SEP = "#"          # sentence prefix "<prompt>#<sentence>" (fine-tune variant)
PROMPT_FIRST_PREFIX = "prompt:"  # extra first sentence "prompt:<prompt>"
MAX_SCORE = 5                # rater scores are integers 0..5
MAX_SENTENCES = 128          # sentence cap per essay (fine-tune variant)
MAX_TOKENS_RAW = 50          # token length, sentences without prompt
MAX_TOKENS_LABELED = 70      # token length, sentences with prompt
SENTENCE_BATCH = 128         # encoder sub-batch
ESSAY_BATCH = {"train": 512, "end_to_end": 128, "fine_tune": 128}
N_EPOCHS = 100
PATIENCE = 10
BASE_SEED = 42
SPLITS = ["train", "valid", "test"]
VARIANTS = [("kobert", False), ("labeled_kobert", True)]
# ---------------------------------------------------------------------------

RATERS = ["r1", "r2"]


def rater_col(rater: int, trait: str) -> str:
    """Column name of a rater score in the essay table, e.g. ``rater1@task_1``."""
    return f"rater{rater}@{trait}"


RATER1_COLS = [rater_col(1, t) for t in TRAITS]
RATER2_COLS = [rater_col(2, t) for t in TRAITS]
REQUIRED_COLUMNS = [PROMPT_COL, TEXT_COL] + RATER1_COLS + RATER2_COLS


def essay_csv_schema() -> T.StructType:
    """Schema of an essay CSV split as the workflow expects it.

    Real exports may hold extra columns in front; ``read_essay_csv`` can take
    a custom schema for those."""
    fields = [T.StructField(PROMPT_COL, T.StringType(), True),
              T.StructField(TEXT_COL, T.StringType(), True)]
    fields += [T.StructField(c, T.IntegerType(), True) for c in RATER1_COLS + RATER2_COLS]
    return T.StructType(fields)


def q(name: str) -> str:
    """Backtick-quote a column name that contains '@' for SQL / F.col."""
    return f"`{name}`"
