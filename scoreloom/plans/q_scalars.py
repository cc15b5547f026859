"""Projections and scalar functions on the driver tables."""

from pyspark.sql import functions as F

from scoreloom.functions import scalars as S
from scoreloom.functions import tables as TB
from scoreloom.operators import actions as A
from scoreloom.operators import joins as J
from scoreloom.plans.registry import query

DEVICES = [(s, s.title()) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")]


def sql_keywords(expr: str, rules, default: str = "other") -> str:
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({expr}), {w!r})' for w in words)} THEN '{role}'" for role, words in rules)
    return f"CASE {arms} ELSE '{default}' END"


@query("canon_key", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS key FROM pages")
def canon_key(t):
    return t.pages.select("page_id", S.canon_key("url").alias("key"))


@query("safe_id", "SELECT page_id, trim(regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g'), '_') AS safe FROM pages")
def safe_id(t):
    return t.pages.select("page_id", S.safe_id("url").alias("safe"))


@query("norm_option", """
    SELECT doc_id, regexp_replace(lower(translate(text, '‐‑‒–—―−‘’“”', '-------''''""')), '[^a-z0-9]+', '', 'g') AS norm
    FROM documents""")
def norm_option(t):
    return t.documents.select("doc_id", S.norm_option("text").alias("norm"))


@query("parse_years", """
    SELECT c_custkey, CASE WHEN y BETWEEN 0 AND 70 THEN y END AS years FROM (
      SELECT c_custkey, try_cast(nullif(regexp_extract(replace(format('{:.2f} yrs', c_acctbal / 100), ',', ''),
             '-?\\d+', 0), '') AS INT) AS y FROM customer)""")
def parse_years(t):
    # format_number rounds the exact value of the double as SQL does; format_string rounds its shortest decimal text
    raw = F.concat(F.format_number(F.col("c_acctbal") / 100, 2), F.lit(" yrs"))
    return t.customer.select("c_custkey", S.parse_years(raw).alias("years"))


@query("decode_choice", """
    SELECT pid, CASE WHEN q_device <> 'MACHINERY' THEN q_device END AS code,
           CASE WHEN q_device = 'MACHINERY' THEN 'Machinery' END AS unknown FROM screening""", px=["screening"])
def decode_choice(t):
    from scoreloom.operators.screening import decode_choice as op
    options = t.spark.createDataFrame(DEVICES, "code string, label string")
    return op(t.screening().select("pid", F.initcap("q_device").alias("q_device")), "q_device", options)


@query("decode_multi", """
    WITH tok AS (SELECT doc_id, trim(u.tok) AS tok, u.i AS i FROM documents,
           LATERAL (SELECT unnest(regexp_split_to_array(text, '[,;\n]+')) AS tok,
                    generate_subscripts(regexp_split_to_array(text, '[,;\n]+'), 1) AS i) u),
         dec AS (SELECT doc_id, i, tok, CASE regexp_replace(lower(tok), '[^a-z0-9]+', '', 'g')
                   WHEN 'the' THEN 'art' WHEN 'of' THEN 'prep' WHEN 'by' THEN 'prep' WHEN 'article' THEN 'art'
                   WHEN 'art' THEN 'art' WHEN 'prep' THEN 'prep' END AS code FROM tok WHERE tok <> '')
    SELECT d.doc_id, (SELECT string_agg(code, ',' ORDER BY i) FROM (SELECT code, min(i) AS i FROM dec
              WHERE dec.doc_id = d.doc_id AND code IS NOT NULL GROUP BY code)) AS codes,
           (SELECT count(*) FROM dec WHERE dec.doc_id = d.doc_id AND code IS NULL) AS n_unknown
    FROM documents d""")
def decode_multi(t):
    d = S.decode_multi("text", [("art", "the"), ("art", "article"), ("prep", "of"), ("prep", "by")])
    return t.documents.select("doc_id", d.alias("d")).select(
        "doc_id", F.array_join("d.codes", ",").alias("codes"), F.size("d.unknown").cast("bigint").alias("n_unknown"))


@query("file_stem", r"""
    SELECT page_id, regexp_extract(url, '([^/\\]+?)(\.[A-Za-z0-9]+)?$', 1) AS stem FROM pages""")
def file_stem(t):
    return t.pages.select("page_id", S.file_stem("url").alias("stem"))


@query("parse_mix_name", r"""
    WITH n AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'mean_reward__' ||
                 regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g') || '__seed' || (page_id % 2) || '.wav' END AS f FROM pages)
    SELECT page_id, nullif(regexp_extract(f, '^([a-z_]+)__(.+)__seed(\d+)\.wav$', 1), '') AS method,
           coalesce(nullif(regexp_extract(f, '^([a-z_]+)__(.+)__seed(\d+)\.wav$', 2), ''), f) AS song,
           try_cast(nullif(regexp_extract(f, '^([a-z_]+)__(.+)__seed(\d+)\.wav$', 3), '') AS INT) AS seed FROM n""")
def parse_mix_name(t):
    name = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(
        F.lit("mean_reward__"), F.regexp_replace("url", "[^0-9A-Za-z._-]+", "_"), F.lit("__seed"),
        (F.col("page_id") % 2).cast("string"), F.lit(".wav")))
    return t.pages.select("page_id", S.parse_mix_name(name).alias("m")).select("page_id", "m.method", "m.song", "m.seed")


def wrapped_props():
    k = F.get_json_object("props", "$.k")
    flat = F.concat(F.lit('{"a.k":'), k, F.lit(',"a":{"k":-1}}'))
    nested = F.concat(F.lit('{"a":{"k":'), k, F.lit("}}"))
    return F.when(F.col("event_id") % 2 == 0, flat).otherwise(nested)


@query("mapped_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def mapped_field(t):
    return t.events.select("event_id", S.mapped_field(wrapped_props(), "a.k").alias("k"))


@query("to_number", """
    SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS x
    FROM events""")
def to_number(t):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "nan").otherwise(F.concat(k, F.lit("?"))))
    return t.events.select("event_id", S.to_number(F.coalesce(raw, k)).alias("x"))


@query("parse_completed", """
    SELECT pid, q_device IN ('BUILDING', 'MACHINERY') AS by_code, pid % 4 < 3 AS by_word,
           CASE WHEN pid % 2 = 0 THEN pid % 4 = 0 END AS by_flag FROM screening""", px=["screening"])
def parse_completed(t):
    words = F.element_at(F.array(F.lit("Yes"), F.lit(" complete"), F.lit("1"), F.lit("no")),
                         (F.col("pid") % 4 + 1).cast("int"))
    flag = F.when(F.col("pid") % 2 == 0, F.col("pid") % 4 == 0)
    return t.screening().select("pid", S.parse_completed("q_device", ["BUILDING", "MACHINERY"]).alias("by_code"),
                                S.parse_completed(words).alias("by_word"), S.parse_completed(flag).alias("by_flag"))


@query("db_conversions", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(pow(10, -l_quantity / 20), 9) AS gain,
           round(20 * log10(l_discount + 1e-12), 6) AS db, round(10 * log10(greatest(l_tax * l_tax, 1e-14)), 6) AS rms
    FROM lineitem""")
def db_conversions(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        F.round(S.db_to_gain(-F.col("l_quantity")), 9).alias("gain"),
        F.round(S.gain_to_db("l_discount"), 6).alias("db"),
        F.round(S.rms_db(F.col("l_tax") * F.col("l_tax")), 6).alias("rms"))


PART_ROLES = [("metal", ["ring", "bolt", "gear"]), ("tool", ["widget", "gadget", "tool"])]


@query("classify_role", f"""
    SELECT p_partkey, {sql_keywords('p_name', TB.ROLE_KEYWORDS)} AS role, {sql_keywords('p_name', PART_ROLES)} AS kind,
           CASE {sql_keywords('p_name', TB.ROLE_KEYWORDS)} WHEN 'hihat' THEN 'drums' WHEN 'kick' THEN 'drums'
                ELSE {sql_keywords('p_name', TB.ROLE_KEYWORDS)} END AS parent FROM part""")
def classify_role(t):
    role = S.classify_role("p_name")
    return t.part.select("p_partkey", role.alias("role"), S.classify_role("p_name", PART_ROLES).alias("kind"),
                         S.parent_role(role).alias("parent"))


@query("is_vocal", """
    WITH n AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Lead ' ELSE '' END || p_name AS name,
                      CASE WHEN p_size % 7 = 0 THEN 'female singer' END AS instrument FROM part)
    SELECT p_partkey, coalesce(regexp_matches(lower(instrument), 'vocal|voice|singer|sing|lead|rap'), false)
           OR regexp_matches(lower(name), 'vocal|voc|lead|sing') AS vocal FROM n""")
def is_vocal(t):
    name = F.concat(F.when(F.col("p_size") % 5 == 0, "Lead ").otherwise(""), "p_name")
    return t.part.select("p_partkey", S.is_vocal(name, F.when(F.col("p_size") % 7 == 0, "female singer")).alias("vocal"))


GENRE_NAME = ("CASE p_type WHEN 'STANDARD' THEN 'Rock---Indie' WHEN 'PROMO' THEN 'Deep House' WHEN 'SMALL' THEN "
              "'Hip-Hop' WHEN 'LARGE' THEN 'Funk / Soul' ELSE p_type END")


@query("coarse_genre", f"SELECT p_partkey, {sql_keywords(GENRE_NAME, TB.GENRE_KEYWORDS, 'default')} AS genre FROM part")
def coarse_genre(t):
    return t.part.select("p_partkey", S.coarse_genre(F.expr(GENRE_NAME)).alias("genre"))


@query("track_name", r"""
    WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Song_Band_STEM_0' || p_partkey % 9 || '_' || p_name
                 WHEN 1 THEN '0' || p_partkey % 9 || '_' || p_name || '_' ELSE '12' END AS f FROM part)
    SELECT p_partkey, CASE WHEN f LIKE '%STEM%' THEN regexp_replace(f, '^.*_STEM_[^_]*_', '')
           ELSE coalesce(nullif(trim(regexp_replace(f, '^\d+[\s_\-]*', ''), '_- '), ''), f) END AS track FROM n""")
def track_name(t):
    k = F.col("p_partkey")
    f = (F.when(k % 3 == 0, F.concat(F.lit("Song_Band_STEM_0"), (k % 9).cast("string"), F.lit("_"), "p_name"))
         .when(k % 3 == 1, F.concat(F.lit("0"), (k % 9).cast("string"), F.lit("_"), "p_name", F.lit("_"))).otherwise("12"))
    return t.part.select("p_partkey", S.track_name(f).alias("track"))


@query("stereo_quality", """
    SELECT vec_id, round(CASE WHEN c BETWEEN 0.3 AND 0.9 THEN 1 WHEN c > 0.9 THEN greatest(0.5, 1 - (c - 0.9) * 5)
             WHEN c >= 0 THEN 0.5 + c / 0.3 * 0.5 ELSE greatest(0, 0.5 + c) END, 6) AS quality
    FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS c FROM embeddings)""")
def stereo_quality(t):
    return t.embeddings.select("vec_id", F.round(S.stereo_quality(F.get("embedding", F.lit(0)).cast("double") * 4), 6)
                               .alias("quality"))


@query("clip_gain", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber >= 6 OR lvl <= -50 THEN 0.0 ELSE
           greatest(-18.0, least(12.0, -20.0 - lvl)) END AS gain
    FROM (SELECT *, CAST(-1.1 * l_quantity AS DOUBLE) AS lvl FROM lineitem)""")
def clip_gain(t):
    level = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).when(F.col("l_linenumber") == 6, F.lit(float("inf"))).otherwise(
        F.col("l_quantity") * -1.1)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                             S.clip_gain(F.lit(-20.0), level).alias("gain"))


@query("apply_gains", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
           round(l_quantity * coalesce(CASE WHEN n_regionkey > 0 THEN s_acctbal / 1000 END, 1.0), 6) AS level
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def apply_gains(t):
    gains = (t.supplier.join(t.nation.where("n_regionkey > 0"), F.col("s_nationkey") == F.col("n_nationkey"))
             .select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 1000).alias("gain")))
    out = J.apply_gains(t.lineitem, gains, ["l_suppkey"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round("l_quantity", 6).alias("level"))


@query("sdr_db", """
    SELECT l_suppkey, round(10 * log10((sum(l_quantity * l_quantity) + 1e-12) /
           (sum((l_quantity - est) * (l_quantity - est)) + 1e-12)), 6) AS sdr
    FROM (SELECT *, l_quantity * (1 - l_discount) AS est FROM lineitem) GROUP BY l_suppkey""")
def sdr_db(t):
    from scoreloom.operators.aggregates import sdr_db as op
    li = t.lineitem.withColumn("est", F.col("l_quantity") * (1 - F.col("l_discount")))
    return op(li, ["l_suppkey"], "l_quantity", "est").select("l_suppkey", F.round("sdr", 6).alias("sdr"))


@query("entropy", """
    WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS p FROM embeddings)
    SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))), 6) AS entropy,
           CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) AS label, round(list_max(p), 6) AS confidence FROM p""")
def entropy(t):
    p = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return (t.embeddings.select("vec_id", p.alias("p")).select("vec_id", F.round(S.entropy("p"), 6).alias("entropy"),
                                                               S.top_label("p").alias("t"))
            .select("vec_id", "entropy", "t.label", F.round("t.confidence", 6).alias("confidence")))


SQL_ARGS = "'k=' || json_extract_string(props, '$.k') || ',user=' || user_id"


def event_args():
    return F.create_map(F.lit("user"), F.col("user_id").cast("string"),
                        F.lit("k"), F.get_json_object("props", "$.k"))


@query("fmt_action", f"SELECT event_id, event_type || '(' || {SQL_ARGS} || ')' AS sig FROM events")
def fmt_action(t):
    return t.events.select("event_id", S.fmt_action("event_type", event_args()).alias("sig"))


@query("action_fingerprint", f"""
    SELECT event_id, substr(sha256(event_type || '(' || {SQL_ARGS} || ')|' || CAST(CAST(value * 100 AS BIGINT) AS VARCHAR)),
           1, 16) AS fingerprint FROM events""")
def action_fingerprint(t):
    sig = S.fmt_action("event_type", event_args())
    scores = F.round(F.col("value") * 100).cast("bigint")
    return t.events.select("event_id", S.action_fingerprint(sig, scores).alias("fingerprint"))


@query("state_lineage_id", """
    WITH RECURSIVE acc AS (SELECT song, step, action, row_number() OVER (PARTITION BY song ORDER BY step) AS i
                 FROM replayed WHERE accepted),
      chain(song, i, step, action, state) AS (
        SELECT song, i, step, action, sha256('' || '|' || action) FROM acc WHERE i = 1
        UNION ALL SELECT a.song, a.i, a.step, a.action, sha256(c.state || '|' || a.action)
        FROM chain c JOIN acc a ON a.song = c.song AND a.i = c.i + 1)
    SELECT song, step, substr(state, 1, 16) AS state_id FROM chain""", px=["search_log", "replayed"])
def state_lineage_id(t):
    out = A.state_lineage_id(t.replayed().where("accepted"), ["song"], "step", "action")
    return out.select("song", "step", F.substring("state_id", 1, 16).alias("state_id"))


@query("db_to_gain", "SELECT event_id, round(pow(10, value / 200), 9) AS gain FROM events")
def db_to_gain(t):
    return t.events.select("event_id", F.round(S.db_to_gain(F.col("value") / 10), 9).alias("gain"))


@query("gain_to_db", "SELECT event_id, round(20 * log10(value + 1e-12), 6) AS db FROM events")
def gain_to_db(t):
    return t.events.select("event_id", F.round(S.gain_to_db("value"), 6).alias("db"))


@query("rms_db", "SELECT event_id, round(10 * log10(greatest(value * value, 1e-14)), 6) AS db FROM events")
def rms_db(t):
    return t.events.select("event_id", F.round(S.rms_db(F.col("value") * F.col("value")), 6).alias("db"))


@query("top_label", """
    SELECT vec_id, CASE list_position(embedding, list_max(embedding)) WHEN 1 THEN 'rock' WHEN 2 THEN 'pop'
           ELSE CAST(list_position(embedding, list_max(embedding)) - 1 AS VARCHAR) END AS label FROM embeddings""")
def top_label(t):
    return t.embeddings.select("vec_id", S.top_label("embedding", ["rock", "pop"])["label"].alias("label"))
