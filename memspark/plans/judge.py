"""A model as judge: batches of prompts in tasks, retries, and errors told beside the answers.

``judge`` is a function of the user, from a list of prompts to as many answers (text with a JSON object).
It runs in the tasks on Arrow batches; the answers feed grounding, attribution, contradiction and re-ranking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.plans.consolidate import GROUNDING_BATCH, attribution_resolve, grounding_resolve
from memspark.session import materialize

#: Prompts of one call, and how often a failing call is made anew.
PROMPTS, RETRIES = 20, 2


def ask_judge(prompts: DataFrame, judge: Callable[[list[str]], list[str]], *, batch: int = PROMPTS, retries: int = RETRIES) -> DataFrame:
    """``prompts`` (with ``prompt``) plus ``answer`` and ``error``, one of them null.

    A call that fails for good is made again prompt by prompt, so one bad prompt costs no other its answer.
    The rows are written: an answer is asked for once, however often it is used.
    """

    def call(some: list[str]) -> tuple[list[str] | None, str | None]:
        error = None
        for _ in range(1 + retries):
            try:
                answers = list(judge(some))
                if len(answers) == len(some):
                    return answers, None
                error = f"{len(answers)} answers to {len(some)} prompts"
            except Exception as problem:  # whatever the user's function raises is the row's error
                error = f"{type(problem).__name__}: {problem}"
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            asked = rows.column(rows.schema.get_field_index("prompt")).to_pylist()
            answers: list[str | None] = []
            errors: list[str | None] = []
            for at in range(0, len(asked), batch):
                some = asked[at : at + batch]
                said, error = call(some)
                each = [(a, None) for a in said] if said is not None else [((r[0] if r else None), e) for r, e in (call([p]) for p in some)] if len(some) > 1 else [(None, error)]
                answers += [a for a, _ in each]
                errors += [e for _, e in each]
            columns = [*rows.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "answer", "error"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in prompts.dtypes], "answer string", "error string"])
    return materialize(prompts.mapInArrow(run, schema), "answers")


def grounding_prompts(facts: DataFrame, keys: list[str], sources: DataFrame, *, batch: int = GROUNDING_BATCH) -> DataFrame:
    """One prompt for each ``batch`` literal facts of a key: keys, batch_no, prompt.

    ``facts``: keys, fact_no, fact, is_inference. ``sources``: keys, source.
    """
    literal = facts.filter(~F.col("is_inference"))
    numbered = literal.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("fact_no")) - 1)
    row = F.struct((F.col("_n") % batch + 1).cast("int").alias("i"), F.col("fact").alias("fact"))
    listed = numbered.groupBy(*keys, F.floor(F.col("_n") / batch).alias("batch_no")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("_facts"))
    ask = F.lit('Which of these facts does the source state? Answer {"grounded":[{"i":1,"ok":true}]} with every number.')
    return listed.join(sources, keys).select(*keys, "batch_no", F.concat_ws("\n", ask, F.concat(F.lit("FACTS "), "_facts"), F.concat(F.lit("SOURCE "), "source")).alias("prompt"))


def judged_grounding(facts: DataFrame, keys: list[str], sources: DataFrame, judge: Callable[[list[str]], list[str]], **options) -> DataFrame:
    """``facts`` with ``grounded``; those whose prompt got no answer are not grounded and carry its ``error``."""
    said = ask_judge(grounding_prompts(facts, keys, sources), judge, **options)
    resolved = grounding_resolve(facts, said.filter("answer is not null").select(*keys, "batch_no", "answer"), keys)
    order = W.partitionBy(*keys).orderBy("fact_no")
    literal = facts.filter(~F.col("is_inference")).select(*keys, "fact_no", F.floor((F.row_number().over(order) - 1) / GROUNDING_BATCH).alias("batch_no"))
    failed = literal.join(said.filter("error is not null").select(*keys, "batch_no", "error"), [*keys, "batch_no"]).drop("batch_no")
    return resolved.join(failed, [*keys, "fact_no"], "left")


def judged_attribution(answers: DataFrame, keys: list[str], judge: Callable[[list[str]], list[str]], **options) -> DataFrame:
    """Used flag of each citation of an answer: keys, pos, citation, used (null where the judge gave none).

    ``answers``: keys, reply, citations (array of text).
    """
    ask = F.lit('Which citations does the reply use? Answer {"used":[true,false]} with one flag for each.')
    prompt = F.concat_ws("\n", ask, F.concat(F.lit("CITATIONS "), F.to_json("citations")), F.concat(F.lit("REPLY "), F.col("reply")))
    said = ask_judge(answers.select(*keys, "citations", prompt.alias("prompt")), judge, **options)
    return attribution_resolve(said.select(*keys, "citations", F.coalesce("answer", F.lit("")).alias("answer")), keys)
