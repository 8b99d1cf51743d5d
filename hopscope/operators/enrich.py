"""Look-ups: prefixes, subnets, names and substring patterns."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.net import network

#: Rows of a pattern table that are taken at once, and of a prefix table that is broadcast.
CHUNK, BROADCAST = 50_000, 500_000


def _ladder(prefixes: DataFrame, number: str) -> tuple[list[tuple[int, Column]], bool]:
    """The prefix lengths that occur (33 at most) with each row's network at that length, and whether the table is small."""
    lengths = sorted(tuple(r) for r in prefixes.groupBy("plen").count().collect())
    return [(n, network(F.col(number), F.lit(n))) for n, _ in lengths], sum(c for _, c in lengths) <= BROADCAST


def longest_prefix(rows: DataFrame, prefixes: DataFrame, number: str, values: list[str]) -> DataFrame:
    """Add ``values`` of the longest prefix that holds the address ``number``; nulls where none does.

    ``prefixes``: net, plen, values. Distinct addresses meet prefixes by equality of (network, length),
    an entry for each length that occurs, so no range join is needed and either side may be large. A table
    of at most ``BROADCAST`` prefixes is broadcast; then only the distinct addresses and the rows are shuffled.
    """
    ladder, few = _ladder(prefixes, number)
    if not ladder:
        return rows.select("*", *[F.lit(None).cast(prefixes.schema[v].dataType).alias(v) for v in values], F.lit(None).cast("int").alias("plen"))
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("plen"), net.alias("net")) for n, net in ladder])).alias("s")
    probes = rows.select(number).distinct().where(F.col(number).isNotNull()).select(number, steps).select(number, "s.plen", "s.net")
    table = prefixes.select(F.col("plen").cast("int").alias("plen"), F.col("net").cast("bigint").alias("net"), *values).dropDuplicates(["plen", "net"])
    best = probes.join(F.broadcast(table) if few else table, ["plen", "net"]).groupBy(number).agg(F.max_by(F.struct("plen", *values), "plen").alias("b")).select(number, "b.*")
    return rows.join(best, number, "left")


def in_subnets(rows: DataFrame, subnets: DataFrame, number: str, how: str = "left_semi") -> DataFrame:
    """Rows whose address lies in one of ``subnets`` (net, plen); ``how`` may be left_anti."""
    ladder, few = _ladder(subnets, number)
    if not ladder:
        return rows.where(F.lit(how != "left_semi"))
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("plen"), net.alias("net")) for n, net in ladder])).alias("s")
    nets = subnets.select("plen", "net").distinct()
    hits = rows.select(number).distinct().where(F.col(number).isNotNull()).select(number, steps).select(number, "s.*").join(F.broadcast(nets) if few else nets, ["plen", "net"], "left_semi").select(number).distinct()
    return rows.join(hits, number, how)


def look_up(rows: DataFrame, table: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Left join on ``key`` with a default for each looked-up column; Spark picks the join by size."""
    out = rows.join(table.dropDuplicates([key]), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def on_allow_list(rows: DataFrame, allowed: DataFrame, columns: list[str], key: str = "ip") -> DataFrame:
    """Rows of which one of ``columns`` is in table ``allowed``; each column meets the table by equality."""
    flags = []
    for i, c in enumerate(columns):
        hit = allowed.select(F.col(key).alias(f"_a{i}")).where(F.col(f"_a{i}").isNotNull()).distinct()
        rows = rows.join(hit, F.col(c) == F.col(f"_a{i}"), "left")
        flags.append(f"_a{i}")
    return rows.where(F.coalesce(*flags).isNotNull()).drop(*flags)


def _automaton(needles: list[str]):
    """A function from a batch's lines to (line, needle) numbers of all needles that the lines hold."""
    try:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, needle in enumerate(needles):
            found.add_word(needle, i)
        found.make_automaton()

        def search(lines: pa.Array) -> tuple[list[int], list[int]]:
            at, hit = [], []
            for i, line in enumerate(lines.to_pylist()):
                if line:
                    own = {k for _, k in found.iter(line)}
                    at += [i] * len(own)
                    hit += sorted(own)
            return at, hit
    except ImportError:  # needle by needle

        def search(lines: pa.Array) -> tuple[list[int], list[int]]:
            pairs = sorted((i, k) for k, needle in enumerate(needles) for i in pc.indices_nonzero(pc.fill_null(pc.match_substring(lines, needle), False)).to_pylist())
            return [i for i, _ in pairs], [k for _, k in pairs]

    return search


def holding(rows: DataFrame, line: str, needles: list[str], name: str) -> DataFrame:
    """Each row once for each of the distinct ``needles`` that ``line`` holds, with its number in ``name``.

    The needles are put into an automaton (Aho-Corasick) that each task builds once and runs over its lines: rows stay where they are,
    whatever their length and the number of needles.
    """
    schema = StructType([*rows.schema.fields, StructField(name, IntegerType())])

    def run(batches):
        search = None
        for batch in batches:
            search = search or _automaton(needles)
            at, hit = search(batch.column(batch.schema.get_field_index(line)))
            if at:
                kept = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hit, pa.int32())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def match_patterns(rows: DataFrame, patterns: DataFrame, condition: Column, line: str | None = None, needle: Column | None = None) -> DataFrame:
    """All (row, pattern) pairs that meet ``condition``, which asks for substrings.

    ``needle``: a text of the pattern that ``line`` has to hold for the condition to be met. Then lines are searched for all needles at once
    (``holding``), and what is found meets its patterns by the needle's number; rows aren't shuffled. Patterns are dealt by the hash of ``pattern_id`` (any type) into
    parts of about ``CHUNK`` patterns, of which an automaton is made and which are broadcast, each on its own. Without
    ``needle``, and for patterns whose needle is empty, each row is compared with each pattern of a part.
    """
    if needle is not None:
        patterns = patterns.withColumn("_needle", F.coalesce(needle, F.lit("")))
        found = patterns.where("_needle <> ''")
        empty = patterns.where("_needle = ''").drop("_needle")
        out = None
        for part in _parts(found):
            distinct = sorted(r[0] for r in part.select("_needle").distinct().collect())  # about CHUNK
            numbers = rows.sparkSession.createDataFrame(list(enumerate(distinct)), "_at int, _needle string")
            known = part.join(F.broadcast(numbers), "_needle").drop("_needle")
            got = holding(rows, line, distinct, "_at").join(F.broadcast(known), "_at").where(condition).drop("_at")
            out = got if out is None else out.unionByName(got)
        if out is None:
            return match_patterns(rows, empty, condition)
        return out if empty.isEmpty() else out.unionByName(match_patterns(rows, empty, condition))
    out = None
    for part in _parts(patterns):
        got = rows.join(F.broadcast(part), condition)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.join(F.broadcast(patterns), condition)


def _parts(patterns: DataFrame) -> list[DataFrame]:
    parts = -(-patterns.count() // CHUNK)
    return [patterns.where(F.pmod(F.xxhash64("pattern_id"), F.lit(parts)) == k) if parts > 1 else patterns for k in range(parts)]


def longest(tokens: Column) -> Column:
    """The longest token of an array, the first of equals."""
    return F.aggregate(tokens, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))


def all_tokens_in(line: Column, tokens: Column) -> Column:
    """Every token of an array is a substring of the line."""
    return F.forall(tokens, lambda t: F.contains(line, t))
