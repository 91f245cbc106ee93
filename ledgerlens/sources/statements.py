"""Statement exports: CSV source/sinks and layout renderers.

``read_statements`` reads header CSVs as all-string columns (typing is the
standardizer's job) and tags each row with the file it came from, which is
the account of a one-file-per-account export.  The ``render_*`` functions
turn canonical transactions into the raw layouts the standardizer accepts
(used to exercise it on the driver tables and for round-trip checks).
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# planted label of the fixture (deterministic): large amounts, plus a sparse hash
def planted_fraud() -> F.Column:
    return ((F.col("amount") > 20000) | (F.pmod(F.col("seq") * 7919, F.lit(1000)) < 20)).cast("int")


def read_statements(spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """Header CSV(s) -> string columns + ``source_file`` / ``account_id``
    (file stem) + ``seq``: the rows of a file numbered in file order, which is the
    same however the reader splits or packs files.

    A split begins at ``_metadata.file_block_start`` and the reader keeps file order
    inside it, so a row's place is (file, split start, place in the split); the
    numbers of the splits of one file add up (one row per split)."""
    with _listed_by_cores(spark):
        df = (spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
              .csv(path))
    df = df.withColumn("source_file", F.col("_metadata.file_path"))
    if "account_id" not in df.columns:      # no account=... folders: one file per account
        df = df.withColumn("account_id", F.regexp_extract("source_file", r"([^/]+?)(\.[^./]*)?$", 1))
    # the scan id grows with the place inside a task, and a split is read by one task
    df = df.withColumns({"__id": F.monotonically_increasing_id(), "__at": F.col("_metadata.file_block_start")})
    df = df.withColumn("__nth", F.row_number().over(Window.partitionBy("source_file", "__at").orderBy("__id")))
    sizes = df.groupBy("source_file", "__at").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("source_file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source_file", "__at", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    df = (df.join(sizes, ["source_file", "__at"])
          .withColumn("seq", (F.col("__before") + F.col("__nth") - 1).cast("long")).drop("__id", "__at", "__nth", "__before"))
    if require_rows and df.isEmpty():
        raise ValueError(f"no transaction records in {path}")
    return df


@contextlib.contextmanager
def _listed_by_cores(spark: SparkSession):
    """Folders are listed by twice as many tasks as there are cores; Spark's own way is a task for each folder,
    up to 10 000, which costs more than the listing itself."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(min(int(before or 10_000), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_statements(raw: DataFrame, path: str) -> None:
    """Header CSVs, a folder per account.  The rows are dealt by ranges of (account, statement order)
    first: a task holds few accounts whole, so there is about a file per account, not one per account and
    task, and a very large account is spread over several tasks and files."""
    (raw.repartitionByRange("account_id", "seq").drop("seq")
     .write.partitionBy("account_id").option("header", True).csv(path))


def render_layout_a(txn: DataFrame) -> DataFrame:
    """Raw bank export: type, mode, amount, currentBalance, transactionTimestamp
    (ISO with +05:30 offset, local wall clock), valueDate, txnId, narration."""
    return txn.select(
        "account_id", "seq",
        F.upper("debit_credit").alias("type"), F.col("mode"),
        F.format_number(F.col("amount").cast("double"), 2).alias("amount"),
        F.col("balance").cast("string").alias("currentBalance"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("transactionTimestamp"),
        F.date_format("date", "yyyy-MM-dd").alias("valueDate"),
        F.col("txn_id").alias("txnId"), F.col("narration"))


def render_layout_generic(txn: DataFrame) -> DataFrame:
    """Documented generic CSV: Date (DD-MM-YYYY), Debit/Credit, Amount, Balance,
    Transaction Type, Merchant/Place."""
    return txn.select(
        "account_id", "seq",
        F.date_format("date", "dd-MM-yyyy").alias("Date"), F.col("debit_credit").alias("Debit/Credit"),
        F.col("amount").cast("string").alias("Amount"), F.col("balance").cast("string").alias("Balance"),
        F.col("transaction_type").alias("Transaction Type"), F.col("merchant").alias("Merchant/Place"))


def render_layout_c(txn: DataFrame) -> DataFrame:
    """Another bank: Transaction_Date (YYYY/MM/DD), Time (HH:MM), DR/CR (Dr/Cr),
    Txn-Amount ($1,234.50), Closing_Balance, Payment_Mode, Particulars."""
    return txn.select(
        "account_id", "seq",
        F.date_format("date", "yyyy/MM/dd").alias("Transaction_Date"), F.date_format("ts", "HH:mm").alias("Time"),
        F.when(F.col("debit_credit") == "Debit", "Dr").otherwise("Cr").alias("DR/CR"),
        F.concat(F.lit("$"), F.format_number(F.col("amount").cast("double"), 2)).alias("Txn-Amount"),
        F.col("balance").cast("string").alias("Closing_Balance"),
        F.col("mode").alias("Payment_Mode"), F.concat(F.lit("  "), F.col("narration"), F.lit(" ")).alias("Particulars"))


def render_training_a(txn: DataFrame) -> DataFrame:
    """Labelled layout A (fraud_type + sender_account) with the planted label."""
    fraud = planted_fraud()
    ftype = (F.when(fraud == 0, F.lit("none")).when(F.col("amount") > 20000, F.lit("money_laundering"))
             .when(F.col("mode") == "ATM", F.lit("account_takeover")).otherwise(F.lit("card_fraud")))
    return txn.select(
        "account_id", "seq",
        F.col("amount").cast("string").alias("amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("transaction_type").alias("transaction_type"), F.col("merchant").alias("merchant_category"),
        F.col("mode").alias("payment_channel"), fraud.cast("string").alias("is_fraud"), ftype.alias("fraud_type"),
        F.lit("0.0").alias("anomaly_score"), F.lit("mobile").alias("device_used"),
        F.concat(F.lit("ACC"), F.col("account_id").cast("string")).alias("sender_account"))


def render_dated_lines(txn: DataFrame) -> DataFrame:
    """Dated-line statement text per account (doc): one head line per
    transaction ``DD-MM-YYYY HH:MM <body> <amount> <balance>``, a reference
    continuation line on every third, junk bars on every fifth, and a title
    line before the first transaction."""
    body = F.when(F.col("debit_credit") == "Credit", F.concat(F.lit("NEFT CR-"), F.col("merchant"))).otherwise(
        F.concat(F.col("mode"), F.lit("/"), F.col("merchant")))
    junk = F.when(F.pmod(F.col("seq"), F.lit(5)) == 0, F.lit(" |")).otherwise(F.lit(""))
    head = txn.select(
        F.col("account_id").alias("doc_id"), (F.col("seq") * 3).alias("line_no"),
        F.concat_ws(" ", F.date_format("ts", "dd-MM-yyyy HH:mm"), F.concat(body, junk),
                    F.format_number(F.col("amount").cast("double"), 2),
                    F.format_number(F.col("balance").cast("double"), 2)).alias("text"))
    cont = txn.where(F.pmod(F.col("seq"), F.lit(3)) == 0).select(
        F.col("account_id").alias("doc_id"), (F.col("seq") * 3 + 1).alias("line_no"),
        F.concat(F.lit("REF "), F.lpad(F.col("seq").cast("string"), 12, "0")).alias("text"))
    title = txn.select("account_id").distinct().select(
        F.col("account_id").alias("doc_id"), F.lit(-1).cast("long").alias("line_no"),
        F.concat(F.lit("STATEMENT FOR ACCOUNT "), F.col("account_id").cast("string")).alias("text"))
    return head.unionByName(cont).unionByName(title)


def render_layout_lines(txn: DataFrame, opening: int = 200000) -> DataFrame:
    """Table-layout statement per account: one page per day with a date label
    at the top, description lines (1-3 per transaction), the running balance
    on each transaction's first line, and a BALANCE FORWARD row first."""
    t = F.date_format("ts", "HH:mm:ss")
    m = F.col("mode")
    l1 = (F.when(m == "UPI", F.concat(F.lit("UPI/DR/"), F.col("seq").cast("string"), F.lit("/"), t, F.lit("/"), F.col("merchant")))
          .when(m == "ATM", F.concat(F.lit("ATM WITHDRAWAL "), t, F.lit(" CARD "), F.col("seq").cast("string")))
          .when(m == "POS", F.concat(F.lit("PURCHASE "), F.col("merchant"), F.lit("  IN "), t))
          .when(m == "CARD", F.concat(F.lit("IMPS/"), F.col("seq").cast("string"), F.lit("/"), t))
          .otherwise(F.concat(F.lit("NEFT "), F.col("seq").cast("string"), F.lit(" "), t)))
    l2 = F.when(m == "CARD", F.lit("P2A TRANSFER")).when(m == "NEFT", F.lit("CR"))
    page = F.date_format("date", "yyyyMMdd").cast("int")
    y = (F.unix_micros("ts") - F.unix_micros(F.col("date").cast("timestamp"))).cast("double") / 1e6
    base = txn.select(F.col("account_id").alias("doc_id"), page.alias("page"), "seq", y.alias("y"),
                      l1.alias("l1"), l2.alias("l2"), F.col("merchant"), F.col("balance"), m.alias("mode"))
    empty = F.lit(None).cast("string")
    rows = [base.select("doc_id", "page", (F.col("seq") * 4).alias("line_no"), "y", empty.alias("date_text"),
                        F.col("l1").alias("desc_text"),
                        F.format_number(F.col("balance").cast("double"), 2).alias("balance_text")),
            base.where(F.col("l2").isNotNull()).select(
                "doc_id", "page", (F.col("seq") * 4 + 1).alias("line_no"), (F.col("y") + 0.1).alias("y"),
                empty.alias("date_text"), F.col("l2").alias("desc_text"), empty.alias("balance_text")),
            base.where(F.col("mode").isin("CARD", "NEFT")).select(
                "doc_id", "page", (F.col("seq") * 4 + 2).alias("line_no"), (F.col("y") + 0.2).alias("y"),
                empty.alias("date_text"), F.col("merchant").alias("desc_text"), empty.alias("balance_text"))]
    days = txn.select(F.col("account_id").alias("doc_id"), "date").distinct()
    rows.append(days.select("doc_id", page.alias("page"), F.lit(None).cast("long").alias("line_no"),
                            F.lit(-1.0).alias("y"), F.date_format("date", "dd MMM yy").alias("date_text"),
                            empty.alias("desc_text"), empty.alias("balance_text")))
    first = txn.groupBy("account_id").agg(F.min("date").alias("date"))
    rows.append(first.select(F.col("account_id").alias("doc_id"), page.alias("page"), F.lit(-4).cast("long").alias("line_no"),
                             F.lit(-2.0).alias("y"), empty.alias("date_text"), F.lit("BALANCE FORWARD").alias("desc_text"),
                             F.lit(f"{opening:,.2f}").alias("balance_text")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def render_context_lines(txn: DataFrame) -> DataFrame:
    """Context-line statement text: 'DD.MM.YYYY MODE TRANSFER MERCHANT' then a
    line with the amount and the balance (shifted by 1,000,000 into the
    balance range of this layout); a title line first."""
    a = txn.select(F.col("account_id").alias("doc_id"), (F.col("seq") * 2).alias("line_no"),
                   F.concat_ws(" ", F.date_format("date", "dd.MM.yyyy"), F.col("mode"), F.lit("TRANSFER"),
                               F.col("merchant")).alias("text"))
    b = txn.select(F.col("account_id").alias("doc_id"), (F.col("seq") * 2 + 1).alias("line_no"),
                   F.concat_ws(" ", F.format_number(F.col("amount").cast("double"), 2),
                               F.format_number(F.col("balance").cast("double") + 1000000, 2)).alias("text"))
    title = txn.select("account_id").distinct().select(F.col("account_id").alias("doc_id"),
                                                       F.lit(-1).cast("long").alias("line_no"),
                                                       F.lit("ACCOUNT STATEMENT").alias("text"))
    return a.unionByName(b).unionByName(title)


TABLE_HEADERS = ["Txn Date", "Narration", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"]


def render_table_cells(txn: DataFrame):
    """Digital statement table per account: header cells and long-form data
    cells (doc_id, row_no, col_idx, cell)."""
    docs = txn.select(F.col("account_id").alias("doc_id")).distinct()
    headers = docs.select("doc_id", F.posexplode(F.array(*[F.lit(h) for h in TABLE_HEADERS])).alias("col_idx", "header"))
    vals = F.array(F.date_format("date", "dd/MM/yyyy"), F.col("narration"),
                   F.when(F.col("debit_credit") == "Debit", F.format_number(F.col("amount").cast("double"), 2)).otherwise(F.lit("")),
                   F.when(F.col("debit_credit") == "Credit", F.format_number(F.col("amount").cast("double"), 2)).otherwise(F.lit("")),
                   F.format_number(F.col("balance").cast("double"), 2))
    cells = txn.select(F.col("account_id").alias("doc_id"), F.col("seq").alias("row_no"),
                       F.posexplode(vals).alias("col_idx", "cell"))
    return headers, cells


def load_training(spark: SparkSession, path: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Labelled CSV; optional stable N-row sample (rows ordered by a seeded
    hash of their content, then a top-N: TakeOrderedAndProject, no full sort)."""
    df = read_statements(spark, path)
    if sample:
        content = [c for c in df.columns if c not in ("seq", "source_file", "account_id")]
        df = df.orderBy(F.xxhash64(*content, F.lit(seed)), *content).limit(sample)
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink: arrays become '|'-joined text (CSV cannot hold arrays)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "array":
            c = F.array_join(c.cast("array<string>"), "|")
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON sink (one object per row, nested types kept)."""
    df.write.mode("overwrite").json(path)


def write_report(modules: dict[str, DataFrame], path: str, key: str = "account_id") -> DataFrame:
    """JSON documents of a report: ``path/<module>`` with one object per ``key`` and module, and ``path/master`` with
    one object per key that holds a field for each module (none where the module says nothing on the key).

    ``modules`` have one row per key.  The master is put together from the written modules, so none is
    computed twice.  Returns the master as it was written."""
    master = None
    for name, df in modules.items():
        write_json(df, f"{path}/{name}")
        part = df.sparkSession.read.schema(df.schema).json(f"{path}/{name}")
        part = part.select(key, F.struct(*[F.col(f"`{c}`") for c in part.columns if c != key]).alias(name))
        master = part if master is None else master.join(part, key, "full")
    write_json(master, f"{path}/master")
    return master.sparkSession.read.schema(master.schema).json(f"{path}/master")


def write_table(df: DataFrame, path: str, partition_by: str | None = "month") -> None:
    """Transactions table sink: append, partitioned by month for pruning."""
    d = df
    if partition_by == "month" and "month" not in df.columns:
        d = df.withColumn("month", F.date_format("date", "yyyy-MM"))
    w = d.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


__all__ = ["read_statements", "load_training", "render_layout_a", "render_layout_generic", "render_layout_c",
           "render_training_a", "render_dated_lines", "render_layout_lines", "render_context_lines",
           "render_table_cells", "write_csv", "write_json", "write_report", "write_table", "planted_fraud"]
