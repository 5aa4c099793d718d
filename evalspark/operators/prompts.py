"""Prompt job (L01-L10): one Spark job writes a ``requests`` table from split parts.

The train block is built once per (seed, key) from the few-shot train rows (bounded by the
shot quota) and joined to the test chunks only when the request text is written. Any batch
inference service can answer the requests; :mod:`evalspark.operators.responses` parses
the answers back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket_cumsum, hash_rank, seeded_hash
from ..functions.text import OUTPUT_BASE, OUTPUT_PER_ROW, estimate_tokens, row_to_text
from ..session import small_side

UNIT = ["seed", "key"]

# ---------------------------------------------------------------- fixed values
# System-prompt variants, chosen by prompt index % 6 (index 0 is the benchmark default).
SYSTEM_PROMPTS = [
    "You are an expert tabular-data classifier. You are given a labeled training table "
    "and an unlabeled test table. Learn the pattern from the training rows and assign "
    "each test row to one of the allowed classes. Output one class label per test row.",
    "Act as a machine-learning model for tabular classification. Fit on the provided "
    "training table, then predict the class of every row in the test table. Use only the "
    "listed class labels, one prediction per test row.",
    "You classify structured data points. Treat the labeled rows as your training set, "
    "infer the mapping from features to class, and label each row of the test table. "
    "Answer with one class from the allowed set for every test row.",
    "Your task is in-context tabular prediction. The training table shows how feature "
    "values map to classes. Generalize from it and classify each test-table row, giving "
    "exactly one allowed class label per row.",
    "You are a careful data analyst performing tabular classification. Compare each test "
    "row against the labeled training table and choose the best-matching class. Provide "
    "one class label for every test row, drawn only from the listed classes.",
    "Behave as a tabular classification engine. Given a labeled training table and an "
    "unlabeled test table, predict the class of each test row. Every prediction must be "
    "one of the allowed class labels, one per test row.",
]
# User-message pieces.
MSG_HEAD = "Classification task. Feature columns: "
MSG_CLASSES = "Possible classes: "
MSG_TRAIN = "Training table (each row ends with its true class after '=>'):\n"
MSG_TEST = "Test table ("
MSG_TEST_TAIL = " row(s) to classify):\n"
DIRECTIVE_OFF = "Without showing your reasoning,"
DIRECTIVE_ON = "Reason step by step, then"
MSG_ASK = (" give the predicted class for every test row. On the final lines output exactly "
           "one prediction per test row, in order, in the format:\n")
FMT_PLAIN = "Row <n>: <class>"
FMT_PROBA = ("Row <n>: <class> p=<probability>\nwhere <probability> is your confidence that "
             "the row belongs to <class>, a number between 0 and 1.")
MSG_ONLY = "\nUse only the class labels from: "
# ---------------------------------------------------------------- end of fixed values


def label_codec(train: DataFrame, hide_labels: bool = True, keys=UNIT) -> DataFrame:
    """Classes sorted as strings; token = ``C<i>`` (hidden labels) or the label."""
    keys = list(keys)
    cls = train.select(*keys, F.col("target").cast("string").alias("cls")).distinct()
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("cls")) - 1
    tok = F.concat(F.lit("C"), rank.cast("string")) if hide_labels else F.col("cls")
    return cls.select(*keys, "cls", tok.alias("token"), rank.alias("cls_idx"))


def train_block(train: DataFrame, features: list[tuple[str, bool]], codec: DataFrame,
                keys=UNIT) -> DataFrame:
    """Numbered lines ``i) feats => token`` per (seed, key), i by md5(seed:row_id).

    ``collect_list`` here is bounded by the few-shot train quota (the rows a prompt can hold).
    """
    keys = list(keys)
    t = train.withColumn("cls", F.col("target").cast("string")).join(codec, keys + ["cls"])
    t = t.withColumn("__h", seeded_hash("seed", "row_id"))
    t = t.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("__h", "row_id")))
    line = F.concat(F.col("i").cast("string"), F.lit(") "), row_to_text(features), F.lit(" => "),
                    F.col("token"))
    return t.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))),
                                 lambda s: s["l"]), "\n").alias("train_block"),
        F.count(F.lit(1)).alias("n_train"))


def chunk_rows(test: DataFrame, batch_size: int, keys=UNIT) -> DataFrame:
    """Test rows numbered by md5 order within the unit, chunk = floor((pos-1)/bs);
    ``row_in_chunk`` is the 1-based row number the model answers with. The numbering is
    an exact distributed rank (:func:`hash_rank`), so a large unit is not sorted in one task."""
    keys = list(keys)
    t = test.withColumn("__h", seeded_hash("seed", "row_id"))
    t = hash_rank(t, keys, "__h", "row_id", out="pos")
    return (t.withColumn("chunk", F.floor((F.col("pos") - 1) / batch_size).cast("int"))
            .withColumn("row_in_chunk", ((F.col("pos") - 1) % batch_size + 1).cast("int"))
            .drop("__h"))


def build_requests(train: DataFrame, test: DataFrame, features: list[tuple[str, bool]],
                   batch_size: int = 1, hide_labels: bool = True, prompt_index: int = 0,
                   reasoning: bool = False, elicit_proba: bool = False,
                   model: str = "ICL-0", keys=UNIT) -> DataFrame:
    """L07 + L08: one request per (seed, key, chunk) with system prompt and user message.

    Output: seed, key, model, chunk, row_ids, n_rows, system_prompt, prompt, prompt_sha256,
    est_tokens.
    """
    keys = list(keys)
    codec = label_codec(train, hide_labels, keys)
    block = train_block(train, features, codec, keys)
    classes = codec.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cls_idx", "token"))),
                                 lambda s: s["token"]), ", ").alias("class_list"))
    ch = chunk_rows(test, batch_size, keys)
    line = F.concat(F.col("row_in_chunk").cast("string"), F.lit(") "), row_to_text(features))
    chunks = ch.groupBy(*keys, "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_in_chunk", line.alias("l")))),
                                 lambda s: s["l"]), "\n").alias("test_block"),
        F.transform(F.array_sort(F.collect_list(F.struct("row_in_chunk", "row_id"))),
                    lambda s: s["row_id"]).alias("row_ids"))
    chunks = chunks.withColumn("n_rows", F.size("row_ids").cast("long"))
    j = chunks.join(small_side(block.join(classes, keys), "prompt-heads"), keys)
    msg = user_message(F.col("class_list"), F.col("train_block"), F.col("test_block"),
                       F.col("n_rows"), [f for f, _ in features], reasoning, elicit_proba)
    system = F.lit(SYSTEM_PROMPTS[prompt_index % len(SYSTEM_PROMPTS)])
    return j.select(*keys, F.lit(model).alias("model"), "chunk", "row_ids", "n_rows",
                    system.alias("system_prompt"), msg.alias("prompt"),
                    F.sha2(system, 256).alias("prompt_sha256"),
                    estimate_tokens(F.concat(system, F.lit("\n"), msg)).alias("est_tokens"))


def user_message(class_list: Column, block: Column, test_block: Column, n_rows: Column,
                 feature_names: list[str], reasoning: bool = False,
                 elicit_proba: bool = False) -> Column:
    """The request text (fixed wording above)."""
    return F.concat(
        F.lit(MSG_HEAD + ", ".join(feature_names) + ".\n"), F.lit(MSG_CLASSES), class_list,
        F.lit(".\n\n"), F.lit(MSG_TRAIN), block, F.lit("\n\n"), F.lit(MSG_TEST),
        n_rows.cast("string"), F.lit(MSG_TEST_TAIL), test_block, F.lit("\n\n"),
        F.lit(DIRECTIVE_ON if reasoning else DIRECTIVE_OFF), F.lit(MSG_ASK),
        F.lit(FMT_PROBA if elicit_proba else FMT_PLAIN), F.lit(MSG_ONLY), class_list, F.lit("."))


def prompt_variant(df: DataFrame, index_col: str = "prompt_index") -> DataFrame:
    """System prompt by ``index % 6`` plus its SHA-256 (provenance)."""
    arr = F.array(*[F.lit(p) for p in SYSTEM_PROMPTS])
    sp = F.element_at(arr, (F.pmod(F.col(index_col), F.lit(len(SYSTEM_PROMPTS))) + 1).cast("int"))
    return df.withColumn("system_prompt", sp).withColumn("prompt_sha256", F.sha2(sp, 256))


def answer_budget(n_rows: Column, max_tokens: int, reasoning: bool = False) -> Column:
    """Completion budget: all of max_tokens with reasoning, else base + per-row lines."""
    if reasoning:
        return F.lit(max_tokens)
    return F.least(F.lit(max_tokens), F.lit(OUTPUT_BASE) + F.lit(OUTPUT_PER_ROW) * n_rows)


def context_skip(one_row_requests: DataFrame, windows: DataFrame, max_tokens: int = 16384,
                 reasoning: bool = False) -> DataFrame:
    """Skip a (unit, model) when train block + one test row + reserved answer
    exceeds the model's context window. ``windows``: (model, context_window)."""
    r = one_row_requests.join(windows, "model")
    est = F.col("est_tokens")
    reserve = answer_budget(F.lit(1), max_tokens, reasoning)
    total = est + reserve
    return r.select(*UNIT, "model", est.alias("est_input"), reserve.alias("reserve"),
                    total.alias("total"), "context_window",
                    F.when(total > F.col("context_window"), F.format_string(
                        "exceeds %s context window: ~%d tokens (input ~%d + reserved output %d) > %d",
                        F.col("model"), total, est, reserve, F.col("context_window")))
                    .alias("skip_reason"))


def pack_by_budget(rows: DataFrame, budget: Column, keys=UNIT, size_col: str = "row_tokens",
                   order_hex: str = "__h", tiebreak: str = "row_id", overhead: Column | None = None) -> DataFrame:
    """L10 (re-aimed): size-aware chunking up front instead of halving on overflow.

    Rows are taken in md5 order and laid end to end along bins of ``budget`` tokens (net of
    ``overhead``: the train block and the reserved answer). Rows inside one bin share an even
    chunk, a row across two bins is an odd chunk of its own, so no chunk exceeds the budget.
    The running sum is computed bucket by bucket (:func:`bucket_cumsum`). A row larger than
    the whole budget, and every row where nothing is left of it, is flagged ``too_large`` (the
    unit becomes a context skip).
    """
    keys = list(keys)
    r = rows if order_hex in rows.columns else rows.withColumn(order_hex, seeded_hash("seed", tiebreak))
    r = bucket_cumsum(r, keys, F.substring(order_hex, 1, 3), [F.col(order_hex), F.col(tiebreak)], size_col, "cum_tokens")
    bin_size = F.greatest(F.col("__budget"), F.lit(1))
    last = F.floor((F.col("cum_tokens") - 1) / bin_size)
    first = F.floor((F.col("cum_tokens") - F.col(size_col)) / bin_size)
    return (r.withColumn("__budget", budget if overhead is None else budget - overhead)
            .withColumn("chunk", (2 * last - F.when(first < last, 1).otherwise(0)).cast("int"))
            .withColumn("too_large", (F.col("__budget") <= 0) | (F.col(size_col) > F.col("__budget"))).drop("__budget", order_hex))
