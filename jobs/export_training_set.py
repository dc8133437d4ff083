"""Job: conversations to a fine-tuning set with splits, rejected ones with their reason, and a length profile.

    python -m jobs.export_training_set --config jobs/export_training_set.json [--input P] [--output P]

Output: ``examples``, JSON lines in folders by split (train, validation, rejected), and
``profile``, Parquet, the number of examples and the percentiles of their tokens by split
and reason. An example is a conversation's turns in order in chat markup. Rejected are
conversations without a user's or without an assistant's turn, those longer than
``max_tokens``, and all but the first of those with the same markup. A conversation's
split follows from its id and the seed, so a later run over more conversations leaves the
earlier ones where they were. Both outputs are replaced whole; a rerun gives the same.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.session import prepare
from docloom.functions.text import estimate_tokens

from .common import configured, session

log = logging.getLogger("jobs.export_training_set")
DEFAULTS = {"max_tokens": 384, "validation_percent": 20, "seed": 42}
EXAMPLE = "conv_id long, n_turns long, tokens long, text string, reason string, split string"
#: Characters of markup around a turn's role and text, and of the newline between turns.
MARKUP = len("<|im_start|>\n<|im_end|>\n")


def examples(turns: DataFrame, max_tokens: int, validation_percent: int, seed: int) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> conv_id, n_turns, tokens, text, reason, split.

    Blank turns are left out; rows without conv_id too. Sizes are summed first, so only turns
    of conversations within the limit are gathered: a group holds no more than the limit.
    Turns of equal number are in the order of role and text. The text of a rejected
    conversation is kept only where it was gathered.
    """
    said = turns.where("conv_id is not null and trim(coalesce(text, '')) <> ''").select("conv_id", "turn", "role", "text")
    role = F.coalesce("role", F.lit(""))
    sizes = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text") + F.length(role) + MARKUP).alias("chars"), F.max((role == "user").cast("int")).alias("asks"), F.max((role == "assistant").cast("int")).alias("replies"))
    tokens = F.greatest(F.lit(1), F.floor((F.col("chars") - 1) / 4)).cast("long")
    reason = F.when(F.col("asks") == 0, "no user").when(F.col("replies") == 0, "no assistant").when(tokens > max_tokens, "too long")
    judged = sizes.select("conv_id", "n_turns", tokens.alias("tokens"), reason.alias("reason"))
    line = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), "text", F.lit("<|im_end|>"))
    short = said.join(judged.where("reason is null").select("conv_id"), "conv_id", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))), lambda x: x["line"]), "\n")
    made = short.groupBy("conv_id").agg(text.alias("text")).withColumn("digest", F.sha2("text", 256))
    # The first of equal texts is found by a partial maximum, so a text of many copies meets in no task.
    first = made.groupBy("digest").agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.lit(True).alias("first"))
    rows = judged.join(made.drop("digest").join(first, "conv_id", "left"), "conv_id", "left")
    why = F.coalesce("reason", F.when(F.col("first").isNull(), "duplicate"))
    place = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("conv_id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(100))
    split = F.when(why.isNotNull(), "rejected").when(place < validation_percent, "validation").otherwise("train")
    return rows.select("conv_id", "n_turns", "tokens", "text", why.alias("reason"), split.alias("split"))


def profile(rows: DataFrame) -> DataFrame:
    """Number, tokens and token percentiles of the examples by split and reason."""
    at = F.percentile("tokens", F.array(*[F.lit(q) for q in (0.5, 0.9, 0.99)]))
    found = rows.groupBy("split", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), at.alias("p"), F.max("tokens").alias("longest"))
    return found.select("split", "reason", "n", "tokens", *[F.col("p")[i].alias(name) for i, name in enumerate(("median", "p90", "p99"))], "longest")


def run(spark: SparkSession, config: dict) -> dict[str, int]:
    """Reads ``input``, replaces both outputs; the number of examples by split."""
    prepare(spark)
    c = {**DEFAULTS, **config}
    turns = spark.read.parquet(c["input"])
    log.info("reading conversations of %s", c["input"])
    rows = examples(turns, c["max_tokens"], c["validation_percent"], c["seed"])
    rows.write.mode("overwrite").partitionBy("split").json(f"{c['output']}/examples", ignoreNullFields=False)
    # Read back, so that the profile is of what was written.
    profile(read_examples(spark, c["output"])).write.mode("overwrite").parquet(f"{c['output']}/profile")
    counts = {r["split"]: r["n"] for r in spark.read.parquet(f"{c['output']}/profile").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    log.info("examples written to %s: %s", c["output"], counts)
    return counts


def read_examples(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(EXAMPLE).json(f"{output}/examples")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    config = configured(parser, "input", "output")
    with session("export training set") as spark:
        run(spark, config)


if __name__ == "__main__":
    main()
