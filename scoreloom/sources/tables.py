"""Dimension and vector sources: manifest, survey CSV, embeddings, section labels, durations."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.scalars import parse_mix_name
from scoreloom.operators.scan import ordinal, step_block
from scoreloom.schemas import DURATIONS
from scoreloom.session import materialize

CLIP = "struct<blind_id: string, file: string>"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(key, song, condition) with blind id and file path as keys, and (trial_id, song); three layouts are known."""
    doc = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))
    item = "struct<trial_id: string, song_id: string, clips: map<string, string>, files: map<string, string>>"
    top = doc.select("raw", F.from_json("raw", f"struct<trials: array<{item}>, practice: {item}, songs: array<{item}>, blind_map: map<string, string>>").alias("d"))
    trials = top.select(F.explode(F.array_compact(F.concat(
        F.coalesce("d.trials", F.array().cast(f"array<{item}>")), F.when(F.col("d.trials").isNotNull(), F.array("d.practice")).otherwise(
            F.array().cast(f"array<{item}>")), F.coalesce("d.songs", F.array().cast(f"array<{item}>"))))).alias("t"))
    clips = trials.select(F.coalesce("t.song_id", F.lit("")).alias("song"), F.explode(F.coalesce("t.clips", "t.files")).alias("condition", "c"))
    clip = F.from_json("c", CLIP)
    keys = F.when(F.col("c").startswith("{"), F.array_compact(F.array(clip["blind_id"], clip["file"]))).otherwise(F.array("c"))
    listed = clips.select(F.explode(keys).alias("key"), "song", "condition")
    flat = top.where(F.col("d.trials").isNull() & F.col("d.songs").isNull()).select(
        F.explode(F.coalesce("d.blind_map", F.from_json("raw", "map<string, string>"))).alias("key", "v"))
    obj, pair = F.from_json("v", "struct<song: string, condition: string>"), F.from_json("v", "array<string>")
    is_obj = F.col("v").startswith("{") & obj["condition"].isNotNull()
    is_pair = F.col("v").startswith("[") & (F.size(pair) == 2)
    flat = flat.where(is_obj | is_pair).select(
        "key", F.when(is_obj, F.coalesce(obj["song"], F.lit(""))).otherwise(F.get(pair, F.lit(0))).alias("song"),
        F.when(is_obj, obj["condition"]).otherwise(F.get(pair, F.lit(1))).alias("condition"))
    trial_map = trials.where(F.coalesce("t.trial_id", F.lit("")) != "").select(F.col("t.trial_id").alias("trial_id"), F.coalesce("t.song_id", F.lit("")).alias("song"))
    return listed.unionByName(flat).where(F.coalesce("key", F.lit("")) != ""), trial_map


def _norm(text: str) -> str:
    return re.sub("[^a-z0-9]+", "", text.lower())


def resolve_columns(headers: Sequence[str], questions: Sequence[tuple[str, str]], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Header of every (question id, label): override, exact id, label, then the id as a token of the header.

    Fails on questions without a header, with several, or sharing one.
    """
    overrides, found, problems = overrides or {}, {}, []
    for qid, label in questions:
        if qid in overrides:
            if overrides[qid] not in headers:
                raise ValueError(f"no column {overrides[qid]!r} for {qid}")
            found[qid] = overrides[qid]
            continue
        token = re.compile(r"(^|[^a-z0-9])" + re.escape(qid) + r"([^a-z0-9]|$)")
        tries = [[h for h in headers if _norm(h) == _norm(qid)], [h for h in headers if _norm(h) == _norm(label)],
                 [h for h in headers if token.search(h.lower()) and h not in found.values()]]
        hits = next((t for t in tries if t), [])
        if len(hits) == 1:
            found[qid] = hits[0]
        else:
            problems.append(f"{qid}: {'no column' if not hits else 'several columns ' + str(hits)}")
    used: dict[str, str] = {}
    for qid, h in found.items():
        if h in used:
            problems.append(f"{qid} and {used[h]} share the column {h!r}")
        used[h] = qid
    if problems:
        raise ValueError("cannot map the survey columns: " + "; ".join(problems))
    return found


# Normalised header names of the participant id and of the duration.
ID_HEADERS = ["participantid", "prolificpid", "prolificid", "id", "submissionid", "responseid"]
DURATION_HEADERS = ["timetaken", "durationinseconds", "duration", "timetakenseconds"]


def read_survey_csv(spark: SparkSession, path: str, questions: Sequence[tuple[str, str]], overrides: dict[str, str] | None = None,
                    id_column: str | None = None) -> DataFrame:
    """Answers with one column per question id plus ``pid`` and ``duration_sec``; only the header is looked at here."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    names = {h.lstrip("﻿"): h for h in raw.columns}
    cols = resolve_columns(list(names), questions, overrides)
    ident = id_column or next((h for h in names if _norm(h) in ID_HEADERS), None)
    if ident is None or ident not in names:
        raise ValueError("no participant id column")
    dur = next((h for h in names if _norm(h) in DURATION_HEADERS), None)
    at = lambda h: F.col(f"`{names[h]}`")
    seconds = F.regexp_replace(at(dur), "[^0-9.]", "").try_cast("double") if dur else F.lit(None).cast("double")
    return raw.select(F.trim(F.coalesce(at(ident), F.lit(""))).alias("pid"), seconds.alias("duration_sec"), *[at(h).alias(q) for q, h in cols.items()])


def read_embeddings(spark: SparkSession, path: str, exclude: Sequence[str] = (), named: bool = True) -> DataFrame:
    """Vector table; with ``named`` the (method, song, seed) come from the ``file`` column. Rows whose file contains
    an excluded text are left out."""
    df = spark.read.parquet(path)
    if not named:
        return df
    for text in exclude:
        df = df.where(~F.contains("file", F.lit(text)))
    return df.withColumn("__m", parse_mix_name("file")).select(*df.columns, "__m.method", "__m.song", "__m.seed").drop("__m")


def read_section_labels(spark: SparkSession, path: str) -> DataFrame:
    """``start end label`` lines of ``.lab`` files: song (from the file name), start_sec, label.

    A line without a label gets ``section_<n>``, n counting the valid lines before it. The lines are written once (this starts a
    job) and counted block by block, so a file, or many files of one name, may hold any number of lines.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract(F.substring_index("_metadata.file_path", "/", -1), r"^([^/]+?)(_SECTIONS)?\.lab$", 1).alias("song"), F.trim("value").alias("line"),
        F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    p = lines.withColumn("p", F.split("line", r"\s+"))
    p = p.withColumn("start_sec", F.get("p", F.lit(0)).try_cast("double")).where((F.size("p") >= 2) & F.col("start_sec").isNotNull())
    own = materialize(p.select(F.url_decode("song").alias("song"), "start_sec", F.when(F.size("p") >= 3, F.element_at("p", -1)).alias("label"), "b", "i"),
                      "section-labels")
    numbered = ordinal(own, ["song"], [F.asc("b"), F.asc("i")], [F.col("b"), step_block("i")])
    label = F.coalesce("label", F.concat(F.lit("section_"), (F.col("rn") - 1).cast("string")))
    return numbered.select("song", "start_sec", label.alias("label"))


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DURATIONS).option("header", "true").csv(path)
