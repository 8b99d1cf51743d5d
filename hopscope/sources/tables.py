"""Readers and writers of the text, CSV, JSON and table formats around captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """CSV (also gzip) with a fixed schema; fields that don't parse become null."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, mode="PERMISSIVE")


def read_tcp_fields(spark: SparkSession, path: str) -> DataFrame:
    """Field extracts without header; rows with a blank field are left out."""
    return read_csv(spark, path, schemas.TCP_FIELDS, header=False).na.drop()


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LATENCY, header=False)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file that they come from."""
    return spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("line"))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Delay pools ``{"delays_seconds": [...]}``, a row for each delay: a file holds an object a line (as ``write_pool`` writes them), or one over several lines."""
    files = spark.read.schema("delays_seconds array<double>")
    columns = F.col("_metadata.file_path").alias("file"), F.col("delays_seconds")
    lines = files.json(path).select(*columns)
    spread = lines.groupBy("file").agg(F.count("delays_seconds").alias("n")).where("n = 0")  # no line is an object
    pools = lines.unionByName(files.json(path, multiLine=True).select(*columns).join(spread.select("file"), "file", "left_semi"))
    return pools.select(F.explode("delays_seconds").alias("delay_s"))


def numbers(line: Column) -> Column:
    """The numeric tokens of a line; lines that begin with # have none."""
    tokens = F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda t: t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")), lambda t: t.cast("double"))
    return F.when(F.trim(line).startswith("#"), F.array().cast("array<double>")).otherwise(tokens)


def read_dist(spark: SparkSession, path: str) -> DataFrame:
    """netem tables: a row for each value."""
    return spark.read.text(path).select(F.explode(numbers(F.col("value"))).alias("value"))


def read_subnets(spark: SparkSession, path: str | None = None, literals: list[str] | None = None) -> DataFrame:
    """Subnets (net, plen) from literals and a file of lines; blank lines are skipped."""
    from ..functions.net import ip_number, network

    rows = spark.createDataFrame([(x,) for x in literals or []], "cidr string")
    if path:
        rows = rows.unionByName(spark.read.text(path).select(F.trim("value").alias("cidr")).where("cidr <> ''"))
    plen = F.coalesce(F.get(F.split("cidr", "/"), F.lit(1)).try_cast("int"), F.lit(32))
    return rows.select(network(ip_number(F.split("cidr", "/")[0]), plen).alias("net"), plen.alias("plen")).where("net IS NOT NULL").distinct()


def prefix_cells(rows: DataFrame) -> DataFrame:
    """Prefix workbook rows (asn, name, prefixes: one a line) as net, plen, asn, name; bad prefixes drop out."""
    from ..functions.net import ip_number, network

    one = rows.select("asn", "name", F.explode(F.split("prefixes", "\n")).alias("p")).select("asn", "name", F.trim("p").alias("p")).where("p <> ''")
    plen = F.coalesce(F.get(F.split("p", "/"), F.lit(1)).try_cast("int"), F.lit(32))
    return one.select(network(ip_number(F.split("p", "/")[0]), plen).alias("net"), plen.alias("plen"), "asn", "name").where("net IS NOT NULL")


def read_vendors(spark: SparkSession, path: str) -> DataFrame:
    """``mac,vendor`` lines split at the first comma, MACs in lower case."""
    at = F.instr("value", ",")
    return spark.read.text(path).where(at > 0).select(F.lower(F.trim(F.substring("value", F.lit(1), at - 1))).alias("mac"), F.trim(F.substring("value", at + 1, F.length("value"))).alias("vendor"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """URL patterns of a file: decoded, without scheme, blank lines skipped; ``pattern_id`` is a hash of the pattern."""
    from ..functions.http import decode_url

    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").select(decode_url(F.col("v")).alias("pattern")).distinct()
    return rows.withColumn("pattern_id", F.xxhash64("pattern"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Model tables: a row for each component of each mixture (``schemas.MODEL``)."""
    return spark.read.schema(schemas.MODEL).parquet(path)


def write_models(models: DataFrame, path: str) -> None:
    """Write mixtures as a model table; columns that a table of components lacks are null."""
    types = [f.split() for f in schemas.MODEL.split(", ")]
    models.select(*[(F.col(c) if c in models.columns else F.lit(None)).cast(t).alias(c) for c, t in types]).write.mode("overwrite").parquet(path)


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """A prefix table as ``write_prefixes`` writes it (AS #, AS Name, AS Prefixes: one a line), as net, plen, asn, name."""
    cells = spark.read.csv(path, schema="`AS #` string, `AS Name` string, `AS Prefixes` string", header=True, multiLine=True, escape='"')
    return prefix_cells(cells.select(F.col("AS #").alias("asn"), F.col("AS Name").alias("name"), F.col("AS Prefixes").alias("prefixes")))


#: What a prefix sheet's columns may be called, in lower case, and how many rows its header is looked for in.
SHEET = {"asn": ["as #", "as", "asn", "as number", "as_number", "number"], "name": ["as name", "as_name", "name", "as description", "organisation", "organization", "owner"], "prefixes": ["as prefixes", "as_prefixes", "prefixes", "prefix", "cidr", "network", "networks"]}
HEAD_ROWS, SHEET_COLUMNS = 10, 24


def _sheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all sheets below a folder as arrays of cells: file, at (from 0), cells. A file is read by one task, in order."""
    names = [f"_c{i}" for i in range(SHEET_COLUMNS)]
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(folder, schema=", ".join(f"{n} string" for n in names), multiLine=True, escape='"', mode="PERMISSIVE")
    cells = F.transform(F.array(*names), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), cells.alias("cells"))


def sheet_headers(rows: DataFrame) -> DataFrame:
    """Where each sheet's header is: file, id, and the column of each field (``SHEET``), from 0.

    Each of a file's first ``HEAD_ROWS`` rows scores a point for each field that one of its cells names; the best one is the header, the first of
    equals. A sheet whose best row lacks a field has null columns. Only those rows take part, so a task sees ten rows a file.
    """
    first = rows.groupBy("file").agg(F.min("id").alias("first"))  # ids rise along a file
    low = rows.join(F.broadcast(first), "file").where(F.col("id") < F.col("first") + HEAD_ROWS)
    lower = F.transform("cells", lambda c: F.lower(c))
    # the names of a field in order of preference; a field's column is the first that has the best of them
    where = {f: F.coalesce(*[F.nullif(F.array_position("lower", n), F.lit(0)) for n in names]) - 1 for f, names in SHEET.items()}
    found = low.withColumn("lower", lower).select("file", "id", *[w.cast("int").alias(f) for f, w in where.items()])
    score = sum((F.col(f).isNotNull().cast("int") for f in SHEET), F.lit(0))
    best = found.groupBy("file").agg(F.max_by(F.struct("id", *SHEET), F.struct(score.alias("score"), (-F.col("id")).alias("first"))).alias("b"))
    return best.select("file", "b.*")


def read_prefix_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix sheets as found (CSV exports with titles above the header, columns in any order and under other names) below a folder, merged: net, plen, asn, name.

    Each file's own header tells its columns. A file without one is an error that names it.
    """
    from ..scratch import cut

    rows = cut(_sheet_rows(spark, folder))
    heads = cut(sheet_headers(rows))
    lost = [r["file"] for r in heads.where(" OR ".join(f"{f} IS NULL" for f in SHEET)).orderBy("file").limit(5).collect()]
    if lost:
        raise ValueError(f"no header row with AS number, AS name and prefixes in the first {HEAD_ROWS} rows of {', '.join(lost)}")
    body = rows.join(F.broadcast(heads.withColumnRenamed("id", "head")), "file").where(F.col("id") > F.col("head"))  # a row for each file
    return prefix_cells(body.select(*[F.get("cells", F.col(f)).alias(f) for f in SHEET]).where("prefixes <> ''"))


def prefix_sheet(prefixes: DataFrame) -> DataFrame:
    """AS #, AS Name, AS Prefixes (distinct, sorted, one a line) of a table (asn, name, prefix); a row for each AS by number."""
    out = prefixes.groupBy("asn").agg(F.min("name").alias("AS Name"), F.array_join(F.array_sort(F.collect_set("prefix")), "\n").alias("AS Prefixes"))  # an AS's prefixes
    return out.orderBy(F.col("asn").try_cast("bigint"), "asn").select(F.col("asn").alias("AS #"), "AS Name", "AS Prefixes")


def write_prefixes(prefixes: DataFrame, path: str) -> None:
    prefix_sheet(prefixes).write.mode("overwrite").csv(path, header=True, escape='"')


def sample_lines(rows: DataFrame, value: str, places: int = 4) -> DataFrame:
    """Samples as lines with ``places`` decimals, sorted: the input of a table of an inverse distribution."""
    return rows.where(F.col(value).isNotNull()).orderBy(value).select(F.format_string(f"%.{places}f", F.col(value)).alias("value"))


def stage(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """A stage table: written once, kept on later runs unless ``overwrite``; read back."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of text files in order of file name, each with its place (value, at from 1), by prefix sums over the files' parts."""
    from ..scratch import cut, few

    part = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", part.alias("part"), F.monotonically_increasing_id().alias("id"))  # ids rise along a part
    first = lines.groupBy("part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    first = cut(first.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))  # a row for each part of a file
    return lines.join(few(first), "part").select("value", (F.col("id") - F.col("first") + F.col("before") + 1).alias("at"))


def write_lines(df: DataFrame, column: str, path: str, one_file: bool = False) -> None:
    """Distinct values as sorted lines, in files whose names are in their order; ``one_file`` is for small results."""
    out = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct().orderBy("value")
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, sep: str = ",", gzip: bool = False, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header, quoteAll=quote_all, sep=sep, escape="\\" if quote_all else '"', compression="gzip" if gzip else "none")


def write_pool(df: DataFrame, value: str, node: str, path: str, most: int = 100_000) -> None:
    """A node's delays as JSON objects of at most about ``most`` delays each, in a folder for each node."""
    sizes = df.groupBy(node).agg(F.ceil(F.count("*") / most).alias("_k"))
    dealt = df.join(sizes, node).withColumn("_part", F.floor(F.rand(7) * F.col("_k")))
    dealt.groupBy(node, "_part").agg(F.collect_list(value).alias("delays_seconds")).drop("_part").write.mode("overwrite").partitionBy(node).json(path)


def write_tree(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each combination of keys."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def report_lines(rows: DataFrame) -> DataFrame:
    """Protocol report (protocol, ip, asn, name) as Markdown lines in order."""
    item = F.when(F.col("asn").isNull(), F.format_string("- %s → ASN Unknown", "ip")).otherwise(F.format_string("- %s → ASN %s (%s)", "ip", "asn", "name"))
    head = rows.select("protocol").distinct().select("protocol", F.lit("").alias("ip"), F.format_string("### Protocol: %s", "protocol").alias("line"))
    return head.unionByName(rows.select("protocol", "ip", item.alias("line"))).orderBy("protocol", "ip").select("line")


def node_report(nodes: DataFrame) -> DataFrame:
    """A node's report in fixed columns, a row for each line: node, line_no, line.

    ``nodes``: node, total, rest (null where there is none), and mu_t, var_t, mu_r, var_r in seconds.
    """
    ms = lambda c: F.format_string("%8.2f ms", c * 1000)
    terminal = F.col("rest").isNull()
    mu_r, var_r = (F.when(terminal, F.lit(0.0)).otherwise(F.col(c)) for c in ("mu_r", "var_r"))
    mu, var = F.col("mu_t") - mu_r, F.col("var_t") - var_r
    shown = mu_r > 0
    rule = lambda c: F.lit(c * 55)
    head = F.concat(F.lit(" ANALYTICAL NODE REPORT: "), F.when(terminal, "TERMINAL (Target Only)").otherwise("INTERMEDIATE (T - R)"))
    line = lambda label, value: F.concat(F.lit(label), value)
    total = [F.lit("[1] TOTAL OBSERVED (T)"), line("    Mean:     ", ms(F.col("mu_t"))), line("    Std Dev:  ", ms(F.sqrt("var_t"))), F.lit("")]
    rest = [F.lit("[2] REST OF NETWORK (R)"), line("    Mean:     ", ms(mu_r)), line("    Std Dev:  ", ms(F.sqrt(var_r))), F.lit("")]
    own = [
        F.lit("[3] ISOLATED NODE RESULT (N)"),
        F.when(mu < 0, F.format_string("    [!] WARNING: Negative Mean (%.2fms).", mu * 1000)).otherwise(line("    Mean:     ", ms(mu))),
        F.when(var < 0, "    [!] WARNING: Negative Variance. Models incompatible.").otherwise(line("    Std Dev:  ", ms(F.sqrt(F.greatest(var, F.lit(0.0)))))),
    ]
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(rule("="), head, rule("="), line("Source Total: ", F.col("total"))), F.when(shown, F.array(line("Source Rest:  ", F.col("rest")))).otherwise(none),
        F.array(rule("-"), *total), F.when(shown, F.array(*rest)).otherwise(none), F.array(rule("-"), *own, rule("=")),
    )
    return nodes.select("node", F.posexplode(lines).alias("line_no", "line"))


def event_lines(events: DataFrame) -> DataFrame:
    """HTTP events (ts_rel, client, server, pkt_len, method or reason) as text lines."""
    return events.select(F.format_string("%.6f  %s -> %s  %d  %s", "ts_rel", "client", "server", "pkt_len", F.coalesce("method", "reason", F.lit("-"))).alias("value"))
