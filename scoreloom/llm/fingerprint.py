"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is read as pieces: up to four characters between white space, counted from the start of each word. Four blank
pieces stand before the text. A run of five pieces is an anchor when the smallest of its pieces' hashes stands first or
last in it (a closed syncmer with one piece as inner substring): the choice depends on the run alone. So an edit changes
the anchors that overlap the rest of its word, wherever whole words are shifted to; in text without blanks (CJK, base64,
long tokens) an inserted character moves all later pieces of the word and changes all its later anchors. Where blanks
stand at piece borders is not seen. The first run is always an anchor. The fingerprint holds the 128 smallest 32-bit
anchor hashes, without their positions; two fingerprints compare by the share of common hashes among the smallest
128 of both, which estimates the share of common anchors (exact where texts have fewer).

Null text counts as empty. Empty texts have the empty fingerprint; it is like another empty one (1), unlike others (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, ranked

K = 5
SKETCH = 128
PIECE = r"[^\x20\x09-\x0D]{1,4}"


def piece_hashes(text: Column) -> Column:
    blanks = F.array(*[F.xxhash64(F.lit(" "))] * (K - 1))
    return F.concat(blanks, F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def anchor_positions(hashes: Column) -> Column:
    """0-based starts of the anchors among the pieces (the blank ones included)."""
    at = lambda i: F.get(hashes, i)
    runs = F.sequence(F.lit(0), F.size(hashes) - K)
    chosen = lambda i: (i == 0) | (F.least(at(i), at(i + K - 1)) <= F.least(*[at(i + j) for j in range(1, K - 1)]))
    return F.when(F.size(hashes) >= K, F.filter(runs, chosen)).otherwise(F.array().cast("array<int>"))


def anchor_hash(hashes: Column, i: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.get(hashes, i + j) for j in range(K)]), 32)


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, at, anchor): every anchor of every text with the piece it starts at, for positional matching."""
    rows = docs.select("doc_id", piece_hashes(F.coalesce("text", F.lit(""))).alias("h"))
    rows = rows.select("doc_id", "h", F.explode(anchor_positions(F.col("h"))).alias("at"))
    return rows.select("doc_id", (F.col("at") - (K - 1)).alias("at"), anchor_hash(F.col("h"), F.col("at")).alias("anchor"))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted sketch of a text column."""
    df = df.withColumn(f"{name}_h", piece_hashes(F.col(text)))
    h = F.col(f"{name}_h")
    found = F.transform(anchor_positions(h), lambda i: anchor_hash(h, i))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(found)), 1, SKETCH)).drop(f"{name}_h")


def sketch_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def next_in_order(ids: DataFrame) -> DataFrame:
    """(pred, doc_id, need) for distinct (doc_id, n): the id after ``pred`` in descending order, the first after the last."""
    placed = cut(ranked(ids, [], [F.desc("doc_id")], "r"), "order")
    count = placed.count()
    ahead = placed.select(F.col("doc_id").alias("pred"), F.floor(F.col("n") / 3).cast("int").alias("need"), ((F.col("r") + 1) % count).alias("r"))
    return ahead.join(placed.select("doc_id", "r"), "r").select("pred", "doc_id", "need") if count else ahead.select("pred", F.col("pred").alias("doc_id"), "need")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of an edited text whose last third comes from the start of the next document.

    The next document follows in descending doc_id; after the last comes the first. Rows that repeat a doc_id each get a
    row of their own; the one with the smallest text hash is the next document of others. Rows without a doc_id have no
    place in that order: their edited text is their text, near_next is null.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = with_sketch(base, "text", "sketch")
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("rows"))
    ids = cut(ids, "ids")
    after = cut(next_in_order(ids.select("doc_id", "n")), "after")
    donors = base.join(after, "doc_id").select("pred", F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("sketch").alias("next_sketch"))
    if not ids.where("rows > 1").isEmpty():
        whole = base.join(after, "doc_id").groupBy("pred", "need").agg(F.min_by(F.struct("text", "sketch"), F.xxhash64("text")).alias("d"))
        donors = whole.select("pred", F.substring("d.text", F.lit(1), F.col("need")).alias("head"), F.col("d.sketch").alias("next_sketch"))
    rows = base.join(donors, F.col("doc_id") == F.col("pred"))
    lost = base.where("doc_id is null").select("doc_id", "text", "sketch", F.lit(None).cast("bigint").alias("pred"), F.lit(None).cast("string").alias("head"),
                                               F.lit(None).cast("array<bigint>").alias("next_sketch"))
    if not docs.where("doc_id is null").isEmpty():
        rows = rows.unionByName(lost)
    n = F.char_length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.when(F.col("head").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), n - m), F.substring("head", F.lit(1), m)))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
