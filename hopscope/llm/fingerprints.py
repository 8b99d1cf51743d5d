"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's lower-cased words make five-word shingles (fewer words: one shingle of all). Each shingle is
hashed once; the upper bits choose one of ``BINS`` bins, whose value is the least hash in it. An empty
bin takes the value of the first filled bin along its own fixed random order of bins (optimal
densification), so borrowed values are independent between bins. The lowest ``BITS`` bits of each value
are packed into the fingerprint. Two fingerprints agree by chance in a share 2^-BITS of the bins that
differ; ``likeness`` takes that off.

Null text counts as empty. A text without words has the fingerprint ''; it is like another such text
(1) and unlike all others (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Powers of two; 8 codes fill a 64-bit word.
BINS, BITS = 128, 8
_SHIFT = 64 - BINS.bit_length() + 1
#: Documents that are neighbours by id are brought together in buckets of about BUCKET_BYTES, in so many at most (then they grow:
#: 1.5 GB for 100 TB, which a task sorts by spilling). Their edges come from about SAMPLED ids a bucket.
MOST_BUCKETS, BUCKET_BYTES, SAMPLED = 65_536, 16 << 20, 50


def _orders() -> list[list[int]]:
    """For each bin, the other bins in a random order of its own, from a fixed seed."""
    rng = random.Random(20)
    return [rng.sample([b for b in range(BINS) if b != j], BINS - 1) for j in range(BINS)]


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add array<long> ``out``: the packed codes of column ``text``; null where it has no words."""
    w, h, m, own, dense = (f"_{x}_{out}" for x in ("words", "hashes", "least", "own", "dense"))
    df = df.withColumn(w, F.expr(rf"array_remove(split(lower(`{text}`), '[\\x20\\x09-\\x0D]+'), '')"))
    df = df.withColumn(h, F.expr(f"sort_array(IF(size({w}) = 0, CAST(array() AS array<bigint>), transform(sequence(1, greatest(size({w}) - 4, 1)), i -> xxhash64(slice({w}, i, 5)))))")).drop(w)
    df = df.withColumn(m, F.expr(f"filter({h}, (x, i) -> i = 0 OR shiftright(x, {_SHIFT}) <> shiftright({h}[i - 1], {_SHIFT}))")).drop(h)
    bins = f"_bins_{out}"
    df = df.withColumn(bins, F.expr(f"transform({m}, x -> shiftright(x, {_SHIFT}) + {BINS // 2})"))
    df = df.withColumn(own, F.expr(f"CASE WHEN size({m}) = {BINS} OR size({m}) = 0 THEN {m} ELSE transform(sequence(0L, {BINS - 1}L), j -> get({m}, CAST(array_position({bins}, j) AS int) - 1)) END")).drop(m, bins)
    orders = _orders()
    probes = ", ".join(f"{own}[array({', '.join(str(o[t]) for o in orders)})[j]]" for t in range(BINS - 1))
    df = df.withColumn(dense, F.expr(f"CASE WHEN size({own}) = 0 THEN {own} WHEN forall({own}, x -> x IS NOT NULL) THEN {own} ELSE transform(sequence(0, {BINS - 1}), j -> coalesce({own}[j], {probes})) END")).drop(own)
    each = 64 // BITS
    word = " | ".join(f"shiftleft({dense}[{each} * q + {k}] & {(1 << BITS) - 1}, {BITS * k})" for k in range(each))
    return df.withColumn(out, F.expr(f"IF(size({dense}) = 0, CAST(NULL AS array<bigint>), transform(sequence(0, {BINS // each - 1}), q -> {word}))")).drop(dense)


def as_text(codes: str) -> Column:
    return F.expr(f"coalesce(concat_ws('', transform({codes}, x -> lower(lpad(hex(x), 16, '0')))), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two code arrays, 0 to 1."""
    lane = (1 << BITS) - 1
    same = f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, d) -> n + " + " + ".join(f"IF((shiftrightunsigned(d, {BITS * k}) & {lane}) = 0, 1, 0)" for k in range(64 // BITS)) + ")"
    chance = f"{2.0**-BITS!r}D"
    return F.expr(f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1D WHEN {a} IS NULL OR {b} IS NULL THEN 0D ELSE greatest(0D, ({same} / {BINS}D - {chance}) / (1D - {chance})) END")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each row's text: id, n_chars, fingerprint."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_codes(rows, "text", "codes").select("doc_id", F.length("text").cast("long").alias("n_chars"), as_text("codes").alias("fingerprint"))


def _with_bucket(rows: DataFrame, edges: list[tuple[int, int]]) -> DataFrame:
    """Add the number of edges (id, hash) at or below a row's, found in two steps in a broadcast row of at most ``MOST_BUCKETS`` edges."""
    if not edges:
        return rows.withColumn("bucket", F.lit(0))
    step = max(1, int(len(edges) ** 0.5))
    runs = [edges[i : i + step] for i in range(0, len(edges), step)]
    kind = "struct<doc_id:long,h:long>"
    table = rows.sparkSession.createDataFrame([([r[0] for r in runs], runs)], f"_coarse array<{kind}>, _fine array<array<{kind}>>")
    own = F.struct("doc_id", "h")
    run = F.size(F.filter("_coarse", lambda e: e <= own))
    found = rows.crossJoin(F.broadcast(table)).withColumn("_run", run)  # one row
    inside = F.size(F.filter(F.get("_fine", F.col("_run") - 1), lambda e: e <= own))
    return found.withColumn("bucket", F.when(F.col("_run") == 0, 0).otherwise((F.col("_run") - 1) * step + inside)).drop("_coarse", "_fine", "_run")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edit: the last quarter of its characters replaced by the next document's first ones.

    The next document is the one of the next larger id (rows of one id in order of a hash of the text, null ids
    first); after the last comes the first, so a single document is followed by itself. Rows are
    dealt by quantiles of (id, hash), from a hashed sample, into buckets that are shuffled once; a copy of the next bucket's first document
    goes along with each bucket. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = min(MOST_BUCKETS, 1 + (size[0] or 0) // BUCKET_BYTES)
    edges: list[tuple[int, int]] = []
    if n > 1:
        share = min(1.0, SAMPLED * n / size[1])
        some = rows.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(41)), F.lit(1_000_003)) <= int(1_000_003 * share)).select("doc_id", "h")
        keys = sorted((tuple(r) for r in some.collect()), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
        edges = list(dict.fromkeys(keys[len(keys) * i // n] for i in range(1, n))) if keys else []
    rows = _with_bucket(rows, edges)
    # the first document of each bucket: at most MOST_BUCKETS keys on the driver
    least = sorted((r["bucket"], tuple(r["first"])) for r in rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("first")).collect())
    heads = [(bucket, *least[(i + 1) % len(least)][1]) for i, (bucket, _) in enumerate(least)]
    heads_df = docs.sparkSession.createDataFrame(heads, "to_bucket int, head_id long, head_h long")
    ghosts = rows.drop("bucket").join(F.broadcast(heads_df), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))).groupBy(F.col("to_bucket").alias("bucket")).agg(F.min("text").alias("text"))
    every = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1)), allowMissingColumns=True)

    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h", "text")
    # the neighbour's text travels once; the codes of the neighbour follow in the same order
    near = every.repartitionByRange(len(edges) + 1, "bucket").withColumn("other", F.lead("text").over(order)).withColumn("place", F.row_number().over(order)).drop("h")
    k = F.floor(F.length("text") / 4).cast("int")
    near = near.withColumn("n_chars", F.length("text"))
    near = near.withColumn("edited", F.when(F.col("ghost") == 0, F.concat(F.substring("text", F.lit(1), F.col("n_chars") - k), F.substring("other", F.lit(1), k)))).drop("other")
    near = with_codes(near, "text", "codes").drop("text")
    near = near.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    near = near.withColumn("next_codes", F.lead("codes").over(Window.partitionBy("bucket").orderBy("place"))).where("ghost = 0")
    near = with_codes(near, "edited", "edited_codes").drop("edited")
    return near.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        as_text("codes").alias("fingerprint"), as_text("edited_codes").alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"), likeness("codes", "next_codes").alias("near_next"),
    )
