"""Object labels from image-text scores: prompts, softmax, aggregation over views and the best labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Labels and prompt templates (fixed values).
LABELS = ("bed", "desk", "chair", "table", "cabinet", "shelf", "drawer", "sofa", "monitor", "box", "trash bin", "unknown furniture")
TEMPLATES = (
    "a colored 3D scan of a {}",
    "a colored point cloud rendering of a {}",
    "a rendered view of a {}",
    "a 3D object rendering of a {}",
)
TOP = 3


def prompts(spark: SparkSession, labels: Sequence[str] = LABELS, templates: Sequence[str] = TEMPLATES) -> DataFrame:
    """(prompt_id, label_pos, label, prompt): every label in every template."""
    rows = [(i * len(templates) + j, i, label, t.format(label)) for i, label in enumerate(labels) for j, t in enumerate(templates)]
    return spark.createDataFrame(rows, "prompt_id int, label_pos int, label string, prompt string")


def softmax(logits: DataFrame) -> DataFrame:
    """Adds ``prob``: the softmax of ``logit`` over all prompts of an object's view."""
    view = Window.partitionBy("object", "view")
    shifted = F.exp(F.col("logit") - F.max("logit").over(view))
    return logits.withColumn("__e", shifted).withColumn("prob", F.col("__e") / F.sum("__e").over(view)).drop("__e")


def label_scores(probs: DataFrame, prompt_table: DataFrame) -> DataFrame:
    """(object, label_pos, label, score): mean over templates, then over views, scaled to add up to 1."""
    named = probs.join(F.broadcast(prompt_table.select("prompt_id", "label_pos", "label")), "prompt_id")
    per_view = named.groupBy("object", "view", "label_pos", "label").agg(F.avg("prob").alias("s"))
    mean = per_view.groupBy("object", "label_pos", "label").agg(F.avg("s").alias("s"))
    total = F.sum("s").over(Window.partitionBy("object"))
    return mean.select("object", "label_pos", "label", F.when(total > 0, F.col("s") / total).otherwise(F.col("s")).alias("score"))


def top_labels(scores: DataFrame, k: int = TOP) -> DataFrame:
    """One row an object: top1_label, top1_score, ...; equal scores in the order of the labels."""
    best = Window.partitionBy("object").orderBy(F.col("score").desc(), "label_pos")
    ranked = scores.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= k)
    wanted = [F.max(F.when(F.col("__k") == i, F.col(c))).alias(f"top{i}_{c}") for i in range(1, k + 1) for c in ("label", "score")]
    return ranked.groupBy("object").agg(*wanted)


def predict(images: DataFrame, prompt_table: DataFrame, model) -> DataFrame:
    """(object, view, prompt_id, logit) from a function (png bytes, prompts) -> logits, where such a model is at hand."""
    rows = [(r.prompt_id, r.prompt) for r in prompt_table.orderBy("prompt_id").collect()]  # a few dozen prompts

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                logits = model(r.png, [p for _, p in rows])
                yield pd.DataFrame({"object": r.object, "view": r.view, "prompt_id": [i for i, _ in rows], "logit": logits})

    kind = dict(images.dtypes)["object"]
    return images.mapInPandas(run, f"object {kind}, view string, prompt_id int, logit double")
