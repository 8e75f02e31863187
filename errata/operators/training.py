"""Training-data operators (J1-J6), re-aimed as table jobs: inputs, rows, split,
label-sequence validity, focal loss as a metric, group centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errata.functions.frames import ordered_join
from errata.schemas import ERROR_LABELS

from errata.functions.rand import draw

MAX_LABELS = 4
N_ERROR_TOKENS = 31  # <error_1> .. <error_31>; 13 and above are reserved


def train_val_split(df: DataFrame, key: str, val_buckets: int = 1, n_buckets: int = 10) -> DataFrame:
    """Hash split (10 % validation by default).  A row's side depends only
    on its key, so the split is stable as the corpus grows."""
    b = F.pmod(draw(F.col(key), F.lit("split")), F.lit(n_buckets))
    return df.withColumn("split", F.when(b < val_buckets, "validation").otherwise("train"))


def label_sequences(df: DataFrame, key: str, output_col: str) -> DataFrame:
    """Validity of a detector label sequence: only known tokens;
    ``<no_error>`` alone; error numbers strictly increasing (so no repeats);
    at most four tokens.  Adds (n_tokens, valid, reason) with the first
    violated rule as reason."""
    toks = F.regexp_extract_all(F.col(output_col), F.lit(r"(<[^<>]*>)"), 1)
    nums = F.transform(toks, lambda t: F.when(t == "<no_error>", F.lit(-1)).otherwise(
        F.regexp_extract(t, r"^<error_(\d+)>$", 1).try_cast("int")))
    known = F.forall(nums, lambda n: n.isNotNull() & ((n == -1) | ((n >= 1) & (n <= N_ERROR_TOKENS))))
    no_err_alone = ~F.array_contains(nums, -1) | (F.size(nums) == 1)
    idx = F.sequence(F.lit(1), F.greatest(F.size(nums) - 1, F.lit(1)))
    increasing = (F.size(nums) <= 1) | F.forall(idx, lambda i: F.element_at(nums, i + 1) > F.element_at(nums, i))
    reason = (F.when(F.size(toks) == 0, "empty").when(~known, "unknown_token")
              .when(~no_err_alone, "no_error_not_alone").when(~increasing, "not_increasing")
              .when(F.size(toks) > MAX_LABELS, "too_long"))
    return df.select("*", F.size(toks).alias("n_tokens"), reason.isNull().alias("valid"), reason.alias("reason"))


def focal_loss(scored: DataFrame, group: str, p_col: str, mask_col: str, gammas: list[float]) -> DataFrame:
    """Mean over masked rows of ``(1 - p)^g * -ln p`` per group and gamma
    (g = 0 is plain cross-entropy); a group with an empty mask scores 0."""
    outs = []
    for g in gammas:
        term = F.pow(F.lit(1.0) - F.col(p_col), F.lit(float(g))) * -F.log(F.col(p_col))
        outs.append(scored.groupBy(group).agg(
            F.lit(float(g)).alias("gamma"),
            F.coalesce(F.sum(F.when(F.col(mask_col), term)) / F.sum(F.when(F.col(mask_col), 1)), F.lit(0.0))
            .alias("loss"),
            F.count(F.when(F.col(mask_col), 1)).alias("n_masked")))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def group_centroids(df: DataFrame, group: str, vec_col: str) -> DataFrame:
    """Element-wise mean vector of each group's members (partial
    aggregation per (group, position)); groups without members do not
    appear.  Returns (group, pos, mean)."""
    e = df.select(group, F.posexplode(vec_col).alias("pos", "x"))
    return e.groupBy(group, "pos").agg(F.avg("x").alias("mean"))


# What the detector is asked, and the sections of its input in order.
INSTRUCTION = "List the errors of the predicted SQL as error tokens in ascending order, or <no_error>."
INPUT_SECTIONS = [
    ("[Question]", "question"), ("[External Knowledge]", "external_knowledge"), ("[Question-Schema Structure]", None),
    ("[Nodes]", "nodes_text"), ("[Edges]", "edges_text"), ("[Predicted SQL]", "predicted_sql"),
    ("[SQL Abstract Syntax Tree]", "ast"), ("[Rule-based Detection Results]", "rule_based"), ("[Execution Results]", "execution")]


def detector_input(examples: DataFrame, asts: DataFrame, graphs: DataFrame, results: DataFrame, findings: DataFrame) -> DataFrame:
    """J1 (inferred from its readers): all that the detector sees, by example.

    ``examples``: (example_id, db_id, question, evidence, predicted_sql); ``asts``:
    (example_id, ast); ``graphs``: (example_id, nodes_text, edges_text);
    ``results``: (example_id, ok, error, row), the predicted query's executed rows
    or failure; ``findings``: (example_id, seq, error_label, message).  Results
    and findings are counted and listed before they meet the examples, so an
    example with many rows costs one.  Absent parts are empty texts."""
    ran = results.groupBy("example_id").agg(
        F.max(F.when(~F.col("ok"), F.coalesce("error", F.lit("failed")))).alias("error"), F.count(F.when(F.col("ok"), 1)).alias("n"))
    execution = ran.select("example_id", F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise(
        F.concat(F.lit("rows: "), F.col("n").cast("string"))).alias("execution"))
    rules = findings.groupBy("example_id").agg(ordered_join(F.concat_ws(": ", "error_label", "message"), F.col("seq"), "\n").alias("rule_based"))
    out = examples.select("example_id", "db_id", "question", F.col("evidence").alias("external_knowledge"), "predicted_sql")
    for part in (asts, graphs, execution, rules):
        out = out.join(part, "example_id", "left")
    text = lambda c, empty="": F.coalesce(c, F.lit(empty)).alias(c)
    return out.select("example_id", "db_id", text("question"), text("external_knowledge"), text("predicted_sql"), text("ast"), text("nodes_text"),
                      text("edges_text"), text("execution", "rows: 0"), text("rule_based", "none"))


def finetune_rows(inputs: DataFrame, labels: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """J2 (inferred from its readers): (example_id, instruction, input, output).

    The input has the nine sections that ``prompts.split_sections`` reads, in
    order; the output is the example's error tokens in ascending order, each
    once, or ``<no_error>``.  ``labels``: (example_id, error_label); unknown
    labels are left out."""
    number = F.create_map(*[x for k, n in enumerate(ERROR_LABELS, 1) for x in (F.lit(n), F.lit(k))])
    known = labels.select("example_id", number[F.col("error_label")].alias("k")).where("k IS NOT NULL").groupBy("example_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("k")), lambda k: F.concat(F.lit("<error_"), k.cast("string"), F.lit(">"))), "").alias("tokens"))
    lines = [F.concat(F.lit(head + "\n"), F.coalesce(F.col(c), F.lit(""))) if c else F.lit(head) for head, c in INPUT_SECTIONS]
    return inputs.join(known, "example_id", "left").select(
        "example_id", F.lit(instruction).alias("instruction"), F.concat_ws("\n", *lines).alias("input"), F.coalesce("tokens", F.lit("<no_error>")).alias("output"))
