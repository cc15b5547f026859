"""Listening-test records: JSON lines, JSON documents or folders of both, to typed tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.scalars import canon_key, mapped_field, parse_completed, to_number
from scoreloom.operators.joins import deblind, resolve_song
from scoreloom.operators.logs import dedupe_last


def _objects(df: DataFrame) -> DataFrame:
    """Keep rows whose text is one JSON object; anything unparsable is dropped."""
    t = F.trim("raw")
    return df.withColumn("raw", t).where(t.startswith("{") & F.try_parse_json(t).isNotNull())


def _line_records(text: DataFrame) -> DataFrame:
    """One record per line, in file order. A line may also hold a whole array or ``{"records": [...]}``."""
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row"))
    lines = text.select(F.trim("value").alias("raw"), seq.alias("__s")).where(F.col("raw") != "")
    return _unfold(lines)


def _unfold(docs: DataFrame) -> DataFrame:
    inner = F.get_json_object("raw", "$.records")
    as_array = F.when(F.col("raw").startswith("["), F.col("raw")).when(inner.startswith("["), inner)
    items = F.when(as_array.isNotNull(), F.from_json(as_array, "array<string>")).otherwise(F.array("raw"))
    out = docs.select(F.posexplode(items).alias("__i", "raw"), "__s")
    return out.select("raw", F.struct("__s.file", "__s.block", "__s.row", F.col("__i").alias("item")).alias("ingest_seq"))


def read_records(spark: SparkSession, path: str, lines: str = "*.jsonl", documents: str = "*.json") -> DataFrame:
    """(raw JSON text, ingest_seq) of every record below ``path``.

    ``*.jsonl`` files are split by lines and so scale with their size; a ``*.json`` file is one document (array,
    ``{"records": [...]}`` or object), or lines when the document as a whole does not parse. ``ingest_seq`` orders
    records by file and position, which is what "last resend wins" needs.
    """
    per_line = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", lines).text(path)
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", documents).text(path, wholetext=True)
    text = F.trim("value")
    valid = F.try_parse_json(text).isNotNull()
    parts = F.when(valid, F.array(text)).otherwise(F.split(text, "\r?\n"))
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("block"))
    whole = docs.select(F.posexplode(parts).alias("__row", "raw"), seq.alias("__f")).where(F.trim("raw") != "")
    whole = whole.select(F.trim("raw").alias("raw"), F.struct("__f.file", "__f.block", F.col("__row").cast("bigint").alias("row")).alias("__s"))
    return _objects(_line_records(per_line).unionByName(_unfold(whole)))


@dataclass(frozen=True)
class Fields:
    """Where each field sits in a record (``a.b`` paths allowed) and what the raw type names mean."""

    paths: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    completed_values: Sequence[str] | None = None

    def get(self, name: str) -> Column:
        return mapped_field("raw", self.paths.get(name, name))

    def type_name(self, canonical: str) -> str:
        return self.types.get(canonical, canonical)


FLAT = Fields()
ENVELOPE = Fields(paths={n: f"payload.{n}" for n in (
    "screen_index", "song", "ratings", "duration_sec", "is_training", "pair_index", "choice", "is_repeat", "repeat_of", "trial_index",
    "correct", "response", "truth", "hp_correct", "ap_correct", "completed", "total_sec", "order_group", "eligible", "provisional", "note")})

KEYS = {"mushra": ["screen_index", "song"], "afc": ["pair_index"], "abx": ["trial_index"], "session": ["stage"]}


def current_records(records: DataFrame, fields: Fields = FLAT) -> DataFrame:
    """Canonical type and participant of every usable record, the last resend per (participant, type, position)."""
    kinds = ("stage1", "mushra", "afc", "abx", "session", "questionnaire", "screen_q", "elig")
    raw_type = fields.get("type")
    kind = F.coalesce(*[F.when(raw_type == fields.type_name(k), F.lit(k)) for k in kinds])
    r = records.withColumns({"kind": kind, "pid": F.nullif(fields.get("pid"), F.lit("")), "__demo": F.coalesce(fields.get("demo"), F.lit("false"))})
    r = r.where(F.col("kind").isNotNull() & F.col("pid").isNotNull() & F.col("__demo").isin("false", "0", "")).drop("__demo")
    spot = F.lit("")
    for k, names in KEYS.items():
        spot = F.when(F.col("kind") == k, F.concat_ws("|", *[F.coalesce(fields.get(n), F.lit("")) for n in names])).otherwise(spot)
    return dedupe_last(r.withColumn("spot", spot), ["pid", "kind", "spot"], ["ingest_seq"])


def typed_tables(current: DataFrame, manifest: DataFrame | None = None, trials: DataFrame | None = None,
                 conditions: Sequence[str] | None = None, fields: Fields = FLAT) -> dict[str, DataFrame]:
    """One table per record type. Blinded rating keys are resolved through the manifest; rows of unknown conditions
    and unparsable scores are dropped, training screens too."""
    g = fields.get
    of = lambda k: current.where(F.col("kind") == k)
    truthy = lambda c: F.coalesce(F.lower(c).isin("true", "1"), F.lit(False))
    m = of("mushra").where(~truthy(g("is_training"))).select(
        F.col("pid").alias("listener"), F.coalesce(g("song"), F.lit("")).alias("song"), g("screen_index").alias("screen"),
        to_number(g("duration_sec")).alias("dur"), F.explode(F.from_json(g("ratings"), "map<string,string>")).alias("blind_key", "__v"))
    m = m.withColumn("score", to_number("__v")).where(F.col("score").isNotNull()).drop("__v")
    if trials is not None:
        m = resolve_song(m, trials)
    if manifest is not None:
        hit = deblind(m, manifest)
        plain = m.join(manifest.select(F.col("key").alias("blind_key")), "blind_key", "left_anti")
        if conditions:
            plain = plain.where(F.col("blind_key").isin(*conditions))
            plain = plain.withColumn("condition", F.col("blind_key"))
            hit = hit.unionByName(plain.select(*hit.columns))
        m = hit
    else:
        m = m.withColumn("condition", F.col("blind_key"))
    if conditions:
        m = m.where(F.col("condition").isin(*conditions))
    mushra = m.select("listener", canon_key("song").alias("song"), "condition", "score", "screen", "dur")
    afc = of("afc").select(
        F.col("pid").alias("listener"), canon_key(F.coalesce(g("song"), F.lit(""))).alias("song"), g("pair_index").try_cast("bigint").alias("pair_index"),
        g("choice").alias("choice"), F.coalesce(F.lower(g("is_repeat")) == "true", g("repeat_of").isNotNull()).alias("is_repeat"),
        g("repeat_of").try_cast("bigint").alias("repeat_of"), to_number(g("duration_sec")).alias("dur"))
    right = F.coalesce(F.lower(g("correct")) == "true", g("response") == g("truth"))
    abx = of("abx").select(F.col("pid").alias("listener"), g("trial_index").alias("trial"), right.alias("correct")).where(F.col("correct").isNotNull())
    stage1 = of("stage1").select(F.col("pid").alias("listener"), g("hp_correct").try_cast("int").alias("hp"), g("ap_correct").try_cast("int").alias("ap"))
    session = of("session").select(F.col("pid").alias("listener"), parse_completed(g("completed"), fields.completed_values).alias("completed"),
                                   to_number(g("total_sec")).alias("total_sec"), g("order_group").alias("order_group"))
    elig = of("elig").select(F.col("pid").alias("listener"), (F.lower(g("eligible")) == "true").alias("client_eligible"),
                             truthy(g("provisional")).alias("provisional"), g("note").alias("note"))
    answers = {k: of(k).select(F.col("pid").alias("listener"), "raw") for k in ("questionnaire", "screen_q")}
    return {"mushra": mushra, "afc": afc, "abx": abx, "stage1": stage1, "session": session, "elig": elig, **answers}


def flatten_scores(df: DataFrame, by: Sequence[str], name: str = "name", score: str = "score", scalar: str | None = None) -> DataFrame:
    """Score maps to long (entity, ``name.key``, value); a scalar score keeps the bare name."""
    rows = df.select(*by, name, F.explode(F.map_entries(score)).alias("__e")).select(
        *by, F.concat_ws(".", name, "__e.key").alias("key"), F.col("__e.value").cast("double").alias("value"))
    if scalar:
        rows = rows.unionByName(df.where(F.col(scalar).isNotNull()).select(*by, F.col(name).alias("key"), F.col(scalar).cast("double").alias("value")))
    return rows
