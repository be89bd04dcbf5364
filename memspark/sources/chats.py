"""Chat transcripts of evaluation sets, flat turns, and the predictions written for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions import timeex as D
from memspark.plans.consolidate import ordered_text
from memspark.schemas import struct

TURN = "array<struct<speaker:string,text:string,img_url:array<string>,blip_caption:string>>"
SAMPLE_DDL = """sample_id string, conversation map<string,string>,
    qa array<struct<question:string,answer:string,category:int,evidence:array<string>,adversarial_answer:string>>"""
HAYSTACK_DDL = """question_id string, question_type string, question string, question_date string, answer string, haystack_dates array<string>,
    haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"""
TURNS_PER_PART = 1000


def read_samples(spark: SparkSession, path: str, many_lines: bool = True) -> DataFrame:
    """Samples whose sessions stand under numbered keys; numeric answers are read as text."""
    return spark.read.schema(struct(SAMPLE_DDL)).json(path, multiLine=many_lines)


def sample_turns(samples: DataFrame) -> DataFrame:
    """One row per turn: sample_id, session_no, session_at, pos, speaker, text."""
    pairs = samples.select("sample_id", "conversation", F.explode("conversation").alias("_key", "_raw"))
    number = F.regexp_extract("_key", r"^session_(\d+)$", 1)
    said = pairs.withColumn("_n", number).filter("_n != ''")
    spoken = F.try_element_at("conversation", F.concat("_key", F.lit("_date_time")))
    turns = said.select(
        "sample_id", F.col("_n").cast("int").alias("session_no"), D.parse_spoken_date(X.strip(spoken)).alias("session_at"),
        F.posexplode(F.from_json("_raw", TURN)).alias("pos", "t"),
    )
    text = X.turn_text(F.col("t.text"), F.get("t.img_url", F.lit(0)), F.col("t.blip_caption"))
    return turns.select("sample_id", "session_no", "session_at", "pos", F.col("t.speaker").alias("speaker"), text.alias("text"))


def sample_questions(samples: DataFrame) -> DataFrame:
    rows = samples.select("sample_id", F.posexplode("qa").alias("question_no", "q"))
    return rows.select("sample_id", "question_no", "q.*")


def read_haystacks(spark: SparkSession, path: str, many_lines: bool = True) -> DataFrame:
    return spark.read.schema(struct(HAYSTACK_DDL)).json(path, multiLine=many_lines)


def haystack_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, rejects): dates and sessions zipped; a row whose counts differ is refused."""
    same = F.size("haystack_dates") == F.size("haystack_sessions")
    zipped = F.arrays_zip(F.col("haystack_dates").alias("at"), F.col("haystack_sessions").alias("turns"))
    sessions = rows.filter(same).select("question_id", F.posexplode(zipped).alias("session_no", "s"))
    turns = sessions.select("question_id", "session_no", D.parse_slash_date(F.col("s.at")).alias("session_at"), F.posexplode("s.turns").alias("pos", "t"))
    return turns.select("question_id", "session_no", "session_at", "pos", "t.role", "t.content"), rows.filter(~same | same.isNull()).select("question_id")


def sessionize_turns(turns: DataFrame, *, per_part: int = TURNS_PER_PART) -> tuple[DataFrame, DataFrame]:
    """(session texts, sessions without a usable date) from flat turns.

    ``turns``: session_index, session_datetime, speaker, text, ord. The last non-empty date of a
    session wins. A text holds at most ``per_part`` turns, further ones are further parts, so a huge
    session does not have to fit into one row.
    """
    said = F.when(X.strip(F.coalesce("session_datetime", F.lit(""))) != "", F.col("session_datetime"))
    dates = turns.groupBy("session_index").agg(F.max_by(said, F.when(said.isNotNull(), F.col("ord"))).alias("_at"))
    dates = dates.withColumn("session_at", D.parse_spoken_date(X.strip(F.col("_at"))))
    line = F.concat("speaker", F.lit(": "), "text")
    parts = turns.withColumn("_line", line).groupBy("session_index", F.floor(F.col("ord") / per_part).alias("part_no")).agg(
        F.count(F.lit(1)).alias("n_turns"), ordered_text("_line", "ord", "\n").alias("text")
    )
    good = parts.join(dates.filter("session_at is not null").select("session_index", "session_at"), "session_index")
    bad = dates.filter("session_at is null").select("session_index", F.col("_at").alias("session_datetime"))
    return good.withColumn("text", X.strip(F.col("text"))), bad


def pending_samples(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Keys with a question that has no non-empty prior answer. ``questions``: key, question_no."""
    done = answers.filter(F.coalesce("answer", F.lit("")) != "").select(key, "question_no").distinct()
    return questions.join(done, [key, "question_no"], "left_anti").select(key).distinct()


def predictions(answers: DataFrame, key: str, *, per_part: int = 200) -> DataFrame:
    """Nested predictions per sample in parts of at most ``per_part`` questions: key, part_no, json."""
    row = F.struct("question_no", "question", "prediction")
    packed = answers.groupBy(key, F.floor(F.col("question_no") / per_part).alias("part_no")).agg(F.array_sort(F.collect_list(row)).alias("qa"))
    return packed.select(key, "part_no", F.to_json(F.struct(key, "qa")).alias("json"))


def hypotheses(answers: DataFrame) -> DataFrame:
    """One JSON line per question."""
    return answers.select(F.to_json(F.struct("question_id", F.col("prediction").alias("hypothesis"))).alias("value"))
