"""Column functions over ids, answers, names, levels and actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions import tables as TB

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN means "missing" in the sources; Spark orders NaN above every number, so drop it on ingest."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def finite(c: ColumnOrName) -> Column:
    """The value when it is a finite number, else null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def epoch_us(ts: ColumnOrName) -> Column:
    """Microseconds since the epoch, for timestamps with and without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts))


# --- ids and names -------------------------------------------------------------------------------


def canon_key(c: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def safe_id(c: ColumnOrName) -> Column:
    return F.btrim(F.regexp_replace(col(c), "[^0-9A-Za-z._-]+", "_"), F.lit("_"))


def norm_option(c: ColumnOrName) -> Column:
    """Comparison form of an answer: only lower-case ASCII letters and digits survive.

    Dash and quote variants need no mapping of their own: none of their unified forms survives either.
    """
    return F.coalesce(canon_key(col(c).cast("string")), F.lit(""))


def file_stem(c: ColumnOrName) -> Column:
    return F.regexp_extract(col(c), r"([^/\\]+?)(\.[A-Za-z0-9]+)?$", 1)


def parse_mix_name(c: ColumnOrName) -> Column:
    """``method__song__seedN.wav`` to struct(method, song, seed); without a match the whole name is the song."""
    c = col(c)
    pattern = r"^([a-z_]+)__(.+)__seed(\d+)\.wav$"
    hit = c.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(c, pattern, 1)).alias("method"),
        F.when(hit, F.regexp_extract(c, pattern, 2)).otherwise(c).alias("song"),
        F.when(hit, F.regexp_extract(c, pattern, 3).cast("int")).alias("seed"),
    )


def stem_track_name(c: ColumnOrName) -> Column:
    """Drop everything up to ``_STEM_NN_`` (else ``_RAW_NN_``); keep the original when nothing is left."""
    c = col(c)
    parts = F.split(c, "_")
    at = F.coalesce(*[F.nullif(F.array_position(parts, m).cast("int"), F.lit(0))
                      for m in ("STEM", "RAW")])
    tail = F.array_join(F.slice(parts, at + 2, F.greatest(F.size(parts), F.lit(1))), "_")
    return F.coalesce(F.nullif(tail, F.lit("")), c)


def numbered_track_name(c: ColumnOrName) -> Column:
    """Drop a leading track number and trim separators; keep the original when nothing is left."""
    c = col(c)
    short = F.btrim(F.regexp_replace(c, r"^\d+[\s_\-]*", ""), F.lit("_- "))
    return F.coalesce(F.nullif(short, F.lit("")), c)


def track_name(c: ColumnOrName) -> Column:
    """Display name of a track in either naming style."""
    c = col(c)
    return F.when(c.rlike("(^|_)(STEM|RAW)(_|$)"), stem_track_name(c)).otherwise(numbered_track_name(c))


def _any_keyword(c: Column, words: Sequence[str]) -> Column:
    """Substring test for a keyword list; ``contains`` per word stays cheaper than a regex alternation."""
    test = c.contains(words[0])
    for w in words[1:]:
        test = test | c.contains(w)
    return test


def classify_role(c: ColumnOrName, rules: Sequence[tuple[str, Sequence[str]]] | None = None,
                  default: str = "other") -> Column:
    """First role of the ordered keyword table that occurs in the lower-cased name."""
    low = F.lower(col(c))
    out = None
    for role, words in rules or TB.ROLE_KEYWORDS:
        test = _any_keyword(low, words)
        out = F.when(test, F.lit(role)) if out is None else out.when(test, F.lit(role))
    return out.otherwise(F.lit(default))


def parent_role(role: ColumnOrName) -> Column:
    return F.when(col(role).isin("hihat", "kick", "drums"), F.lit("drums")).otherwise(col(role))


def is_vocal(name: ColumnOrName, instrument: ColumnOrName | None = None) -> Column:
    by_name = F.coalesce(_any_keyword(F.lower(col(name)), TB.VOCAL_NAME_WORDS), F.lit(False))
    if instrument is None:
        return by_name
    by_instrument = _any_keyword(F.lower(col(instrument)), TB.VOCAL_INSTRUMENT_WORDS)
    return F.coalesce(by_instrument, F.lit(False)) | by_name


def coarse_genre(c: ColumnOrName) -> Column:
    return F.coalesce(classify_role(c, TB.GENRE_KEYWORDS, "default"), F.lit("default"))


# --- answers -------------------------------------------------------------------------------------


def parse_years(c: ColumnOrName) -> Column:
    digits = F.regexp_extract(F.replace(col(c).cast("string"), F.lit(","), F.lit("")), r"-?\d+", 0)
    years = F.nullif(digits, F.lit("")).try_cast("int")
    return F.when(years.between(0, 70), years)


def mapped_field(raw: ColumnOrName, path: str) -> Column:
    """Field-map access to a JSON text: the flat key ``a.b`` wins over the nested path."""
    raw = col(raw)
    flat = F.get_json_object(raw, f"$['{path}']")
    return F.coalesce(flat, F.get_json_object(raw, f"$.{path}")) if "." in path else flat


def to_number(c: ColumnOrName) -> Column:
    return nan_to_null(col(c).try_cast("double"))


def parse_completed(c: ColumnOrName, values: Sequence[str] | None = None) -> Column:
    """Completion flag from a boolean, a list of accepted codes or a truthy word."""
    text = col(c).cast("string")
    if values is not None:
        return F.when(text.isNotNull(), text.isin(*values))
    return F.when(text.isNotNull(), F.lower(F.trim(text)).isin(*TB.TRUTHY_WORDS))


def decode_multi(c: ColumnOrName, options: Sequence[tuple[str, str]]) -> Column:
    """Split a multi-select answer and decode each token: struct(codes in order, unknown tokens)."""
    index = option_map(options)
    tokens = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[,;\n]+"), lambda t: F.trim(t)),
                      lambda t: t != "")
    decode = lambda t: F.element_at(index, norm_option(t))
    codes = F.array_distinct(F.filter(F.transform(tokens, decode), lambda v: v.isNotNull()))
    unknown = F.filter(tokens, lambda t: decode(t).isNull())
    return F.struct(F.when(F.size(codes) > 0, codes).alias("codes"), unknown.alias("unknown"))


def option_map(options: Sequence[tuple[str, str]]) -> Column:
    """Literal map from the normalised code and label to the code."""
    import re
    pairs: dict[str, str] = {}
    for code, label in options:
        for text in (code, label):
            key = re.sub("[^a-z0-9]+", "", text.lower())
            if key and pairs.setdefault(key, code) != code:
                raise ValueError(f"option keys collide: {key!r}")
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def decode_single(c: ColumnOrName, options: Sequence[tuple[str, str]]) -> Column:
    """struct(code, unknown): code or label to code; a non-empty answer outside the options is ``unknown``."""
    text = F.nullif(F.trim(col(c).cast("string")), F.lit(""))
    code = F.element_at(option_map(options), norm_option(text))
    return F.struct(code.alias("code"), F.when(code.isNull(), text).alias("unknown"))


# --- levels and scores ---------------------------------------------------------------------------


def db_to_gain(c: ColumnOrName) -> Column:
    return F.pow(F.lit(10.0), col(c) / 20.0)


def gain_to_db(c: ColumnOrName) -> Column:
    return 20.0 * F.log10(col(c) + 1e-12)


def rms_db(energy: ColumnOrName) -> Column:
    return 10.0 * F.log10(F.greatest(col(energy), F.lit(1e-14)))


def stereo_quality(corr: ColumnOrName) -> Column:
    """Plateau score: best for moderate width, falling towards mono and towards phase inversion."""
    c = col(corr).cast("double")
    return (F.when(c.between(0.3, 0.9), F.lit(1.0))
            .when(c > 0.9, F.greatest(F.lit(0.5), 1.0 - (c - 0.9) * 5.0))
            .when(c >= 0.0, 0.5 + (c / 0.3) * 0.5)
            .otherwise(F.greatest(F.lit(0.0), 0.5 + c)))


def clip_gain(target: ColumnOrName, level: ColumnOrName, lo: float = -18.0, hi: float = 12.0,
              silence: float = -50.0) -> Column:
    """Gain to the target inside ``[lo, hi]``; 0 for rows at or below the silence level and levels that are not finite."""
    level = finite(level)
    gain = F.greatest(F.lit(lo), F.least(F.lit(hi), col(target) - level))
    return F.when(level.isNull() | (level <= silence), F.lit(0.0)).otherwise(gain)


def equal_level_gain(level: ColumnOrName, target: float = -14.0, silence: float = -70.0) -> Column:
    level = finite(level)
    return F.when(level > silence, F.pow(F.lit(10.0), (target - level) / 20.0)).otherwise(F.lit(1.0))


def entropy(probs: ColumnOrName) -> Column:
    terms = F.transform(col(probs), lambda p: p * F.log(p + 1e-12))
    return -F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def top_label(probs: ColumnOrName, labels: Sequence[str] | None = None) -> Column:
    """struct(label, confidence) of the first arg-max; the 0-based index as text without a label list."""
    p = col(probs)
    at = F.array_position(p, F.array_max(p))
    label = (at - 1).cast("string")
    if labels:
        label = F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), (at - 1).cast("int")), label)
    return F.struct(label.alias("label"), F.array_max(p).alias("confidence"))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm2(a: ColumnOrName) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    return dot(a, b) / (norm2(a) * norm2(b) + 1e-9)


def embedding_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return 1.0 - cosine(a, b)


# --- actions -------------------------------------------------------------------------------------


def sorted_entries(args: ColumnOrName) -> Column:
    return F.array_sort(F.map_entries(col(args)))


def fmt_action(action: ColumnOrName, args: ColumnOrName) -> Column:
    """Stable text ``name(k=v,…)`` with the arguments in key order."""
    body = F.array_join(
        F.transform(sorted_entries(args), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return F.concat(col(action), F.lit("("), body, F.lit(")"))


def action_fingerprint(*parts: ColumnOrName) -> Column:
    """16 hex digits over the canonical text of the parts ("was this tried before?")."""
    return F.substring(F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256), 1, 16)


def hash_uniform(*parts: ColumnOrName) -> Column:
    """Deterministic uniform in [0, 1) from the md5 of the parts; equal keys give equal draws everywhere."""
    key = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))
