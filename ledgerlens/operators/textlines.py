"""Statement text -> transactions.

Input tables (byte decoding / OCR is out of scope):

* dated-line text ``lines(doc_id, line_no, text)``: a transaction block
  starts at a ``DD-MM-YYYY`` line; continuation lines attach to it;
* table layout ``layout(doc_id, page, line_no, y, date_text, desc_text,
  balance_text)``: one row per visual line of a statement table.

Ordering work runs inside documents; long documents are split into
line-number buckets and stitched by the bucketed helpers (no unbounded
per-document window over raw lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.functions.windows import bucketed_running_sum, carried, neighbours
from ledgerlens.operators.standardize import inferred_date

LINE_BUCKET = 4096          # lines per ordering bucket of a document

# --- fixed values: patterns of the dated-line layout ---
DATE_START = r"^\d{2}-\d{2}-\d{4}"
DATETIME_RE = r"^(\d{2}-\d{2}-\d{4})\s+(\d{2}:\d{2})"
AMOUNT_RE = r"-?[\d,]+\.\d{2}"
JUNK_RE = r"[\|_\[\]{}]+"
TYPE_PREFIXES = ["NEFT", "RTGS", "IMPS", "UPI", "CHQ DEP", "CHQ", "ATM", "NET TXN", "CASH", "POS", "ECS",
                 "NACH", "ACH", "DD", "IFT", "EMI"]

# --- fixed values: patterns of the table layout ---
TXN_START = (r"(?i)^(ATM WITHDRAWAL|PURCHASE|UPI/|CRADJ/|IMPS/|NEFT |IN\d{4}|CREDIT OF INTEREST|"
             r"NON SCB ATM|CGST|SGST|DISCOUNT ON|IMPS P2A|BALANCE FORWARD|TOTAL\b)")
DATE_LABEL = r"^\d{1,2} \w{3} \d{2}$"


def _blocks(lines: DataFrame, start_pattern: str, keep_before_first: bool, sep: str) -> DataFrame:
    """Group ordered lines into blocks: a line matching ``start_pattern``
    opens a block, other lines join the open one (running count of starts)."""
    d = (lines.withColumn("text", C.strip("text")).where(F.col("text") != "")
         .withColumn("__start", F.col("text").rlike(start_pattern).cast("long"))
         .withColumn("__b", F.floor(F.col("line_no") / LINE_BUCKET).cast("long")))
    d = bucketed_running_sum(d, ["doc_id"], "line_no", "line_no", "__start", "block_no", bucket_col="__b")
    if not keep_before_first:
        d = d.where(F.col("block_no") > 0)
    g = d.groupBy("doc_id", "block_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("__ls"))
    return g.select("doc_id", "block_no", F.array_join(F.transform("__ls", lambda x: x["text"]), sep).alias("block"),
                    F.col("__ls")[0]["line_no"].alias("first_line"))


def group_dated(lines: DataFrame) -> DataFrame:
    """Blocks opened by a DD-MM-YYYY line, joined with spaces; lines
    before the first date are dropped."""
    return _blocks(lines, DATE_START, False, " ")


def drcr(merchant: Column) -> Column:
    """CR / DR from the merchant text (ordered tests)."""
    m = F.upper(merchant)
    return (F.when(m.rlike(r"\bCR[-\s]") | m.rlike(r"\bCR$"), "CR")
            .when(m.contains("CHQ DEP") | m.contains("CHEQUE DEP") | m.contains("CASH DEP"), "CR")
            .when(m.rlike(r"NEFT\s+CR") | m.contains("NEFT-CR"), "CR")
            .otherwise("DR"))


def type_prefix(merchant: Column) -> Column:
    """First matching prefix, else the first word."""
    u = C.strip(F.upper(merchant))
    e = None
    for p in TYPE_PREFIXES:
        e = F.when(u.startswith(p), F.lit(p)) if e is None else e.when(u.startswith(p), F.lit(p))
    first = F.split(u, r"\s+").getItem(0)
    return e.otherwise(F.when(u != "", first).otherwise(F.lit("")))


def parse_dated(blocks: DataFrame) -> DataFrame:
    """``DD-MM-YYYY HH:MM <text> <amount> <balance>`` blocks -> fields;
    blocks without the date-time head or without any amount are dropped."""
    b = F.col("block")
    d = blocks.withColumns({"date": F.regexp_extract(b, DATETIME_RE, 1), "time": F.regexp_extract(b, DATETIME_RE, 2)})
    d = d.where(F.col("date") != "")
    rem = C.strip(F.regexp_replace(b, DATETIME_RE, ""))
    d = d.withColumn("__rem", rem).withColumn("__amts", F.regexp_extract_all("__rem", F.lit(f"({AMOUNT_RE})"), 1))
    d = d.where(F.size("__amts") > 0)
    m = F.regexp_replace("__rem", AMOUNT_RE, " ")
    m = F.regexp_replace(m, r"\b\d{10,}\b", " ")
    m = F.regexp_replace(m, r"\b\d{2}-\d{2}-\d{4}\b", " ")
    m = C.strip(F.regexp_replace(F.regexp_replace(m, JUNK_RE, " "), r"\s{2,}", " "))
    d = d.withColumns({
        "balance": F.element_at("__amts", -1),
        "amount": F.when(F.size("__amts") >= 2, F.element_at("__amts", -2)).otherwise(F.lit("")),
        "merchant": m,
    })
    d = d.withColumns({"debit_credit": drcr(F.col("merchant")), "transaction_type": type_prefix(F.col("merchant"))})
    return d.select("doc_id", "block_no", "first_line", "debit_credit", "amount", "balance", "date", "time",
                    "transaction_type", "merchant")


def dedupe(parsed: DataFrame, keys=("amount", "balance")) -> DataFrame:
    """Keep the first row per (doc, amount, balance); nulls compare equal.
    Grouped ``min_by`` instead of a per-document window."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"__k{i}") for i, c in enumerate(keys)]
    d = parsed.select("*", *k)
    first = d.groupBy("doc_id", *[f"__k{i}" for i in range(len(keys))]).agg(F.min("block_no").alias("block_no"))
    return parsed.join(first.select("doc_id", "block_no"), ["doc_id", "block_no"], "left_semi")


def quality(parsed: DataFrame) -> DataFrame:
    """Rows and valid dates / amounts / balances per document."""
    ok = lambda c: F.count(F.when(F.col(c).isNotNull() & (F.col(c) != ""), 1))
    return parsed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), ok("date").alias("valid_dates"),
                                        ok("amount").alias("valid_amounts"), ok("balance").alias("valid_balances"))


# ------------------------------------------------------------- table layout
def layout_type(desc: Column) -> Column:
    """Ordered keyword classification of a description."""
    d = F.upper(desc)
    return (F.when(d.contains("ATM WITHDRAWAL"), "ATM_WITHDRAWAL")
            .when(d.startswith("UPI/") | d.startswith("CRADJ/UPI"), "UPI")
            .when(d.startswith("IMPS/"), "IMPS")
            .when(d.startswith("NEFT") | d.rlike(r"^IN\d{4}"), "NEFT")
            .when(d.contains("PURCHASE"), "PURCHASE")
            .when(d.contains("CREDIT OF INTEREST"), "INTEREST")
            .when(d.contains("NON SCB ATM") | d.contains("ATM USAGE") | d.contains("IMPS P2A CHARGES"), "CHARGES")
            .when(d.contains("CGST") | d.contains("SGST"), "TAX")
            .when(d.contains("DISCOUNT"), "DISCOUNT")
            .otherwise("OTHER"))


def layout_merchant(desc: Column, ttype: Column) -> Column:
    """PURCHASE by pattern; UPI: '/'-parts 4, 3, 2 first non-numeric;
    IMPS / NEFT: third line."""
    d = C.strip(desc)
    purchase = F.regexp_extract(d, r"(?i)^PURCHASE\s+(.+?)(?:\s{2,}|\s+IN\s|\s+\d{2}:\d{2}:\d{2})", 1)
    parts = F.filter(F.transform(F.split(d, "/"), lambda x: C.strip(x)), lambda x: x != "")
    def part(i):
        v = F.try_element_at(parts, F.lit(i + 1))
        return F.when(v.isNotNull() & (v != "") & ~v.rlike(r"^\d+$"), v)
    upi = F.coalesce(part(4), part(3), part(2))
    lines = F.filter(F.transform(F.split(d, "\n"), lambda x: C.strip(x)), lambda x: x != "")
    third = F.try_element_at(lines, F.lit(3))
    return F.coalesce(
        F.when((ttype == "PURCHASE") & (C.strip(purchase) != ""), C.strip(purchase)),
        F.when(ttype == "UPI", upi),
        F.when(ttype.isin("IMPS", "NEFT"), third),
        F.lit(""))


def layout_time(desc: Column) -> Column:
    """First HH:MM:SS in the description, else ''."""
    return F.regexp_extract(desc, r"\b(\d{2}:\d{2}:\d{2})\b", 1)


def parse_layout(layout: DataFrame) -> DataFrame:
    """T01 + T03 + T04 + T05-T07: description lines grouped into transactions,
    each dated by the nearest date label at or above it on its page (as-of by
    forward fill), amount and side from the balance delta to the previous
    transaction of the document (skip rows only move the previous balance).

    One pass: every line gets the label of its page as of its y, then the number of its block and the
    balance at the block start before it are carried along the document's lines, and the lines of a block meet.
    Of two labels at one y the one on the later line counts."""
    label = C.strip("date_text")
    text = F.col("desc_text")
    said = text.isNotNull() & (C.strip("desc_text") != "")
    page = Window.partitionBy("doc_id", "page").orderBy("y").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lines = layout.select(
        "doc_id", "page", "line_no", "y", said.alias("__said"), C.strip("desc_text").alias("text"),
        F.when(label.rlike(DATE_LABEL), label).alias("__label"),
        (said & text.rlike(TXN_START)).alias("__start"), (said & C.strip("desc_text").rlike(TXN_START)).alias("__opens"),
        F.regexp_replace(C.strip("balance_text"), ",", "").try_cast("double").alias("bal"))
    lines = lines.where(F.col("__said") | F.col("__label").isNotNull()).withColumn(
        "date", F.max(F.when(F.col("__label").isNotNull(), F.struct("y", "line_no", "__label"))).over(page)["__label"])
    lines = carried(lines.where("__said").drop("__said", "__label", "page", "y"), ["doc_id"],
                    F.floor(F.col("line_no") / LINE_BUCKET), ["line_no"],
                    {"__was": F.when(F.col("__start"), F.struct("bal"))}, {"block_no": F.col("__opens").cast("long")},
                    before=["__was"])
    # a line before the first start belongs to no transaction
    own = F.struct("line_no", "text", F.when(F.col("__start"), F.struct("date", "bal", F.col("__was")["bal"].alias("prev"))).alias("head"))
    tx = (lines.where(F.col("block_no") > 0).groupBy("doc_id", "block_no")
          .agg(F.array_sort(F.collect_list(own)).alias("__ls")).withColumn("__head", F.col("__ls")[0]["head"])
          .where(F.col("__head").isNotNull())
          .select("doc_id", "block_no", F.col("__ls")[0]["line_no"].alias("first_line"),
                  F.array_join(F.transform("__ls", lambda x: x["text"]), "\n").alias("block"),
                  F.coalesce("__head.date", F.lit("")).alias("date"), F.col("__head.bal").alias("bal"),
                  F.col("__head.prev").alias("prev_bal")))
    first = F.upper(C.strip(F.split("block", "\n").getItem(0)))
    tx = tx.where(~(first.isin("BALANCE FORWARD", "TOTAL") | first.startswith("TOTAL")))
    delta = F.round(F.col("bal") - F.col("prev_bal"), 2)
    ttype = layout_type(F.col("block"))
    return tx.select(
        "doc_id", "block_no", "first_line",
        F.when(delta.isNull(), "").when(delta < 0, "DEBIT").when(delta > 0, "CREDIT").otherwise("DEBIT").alias("debit_credit"),
        F.abs(delta).alias("amount"), F.col("bal").alias("balance"), "date",
        layout_time(F.col("block")).alias("time"), ttype.alias("transaction_type"),
        layout_merchant(F.col("block"), ttype).alias("merchant"))


# ------------------------------------------------------------ context lines
# fixed values: patterns of the context-line layout
CTX_DATE = r"\b(\d{2}[-./]\d{2}[-./]\d{4})\b"
CTX_AMOUNT = r"(?<!\d)(\d{1,3}(?:,\d{2,3})+\.\d{2})(?!\d)"
CTX_REF = r"\b[A-Z]?\d{8,}\b"
CTX_MODE = r"(?i)\b(NEFT|UPI|IMPS|RTGS|ATM|CASH|CHEQUE|POS)\b"
NOISE = ("THE", "AND", "FOR", "PVT", "LTD", "OAV", "OAW", "EFT", "NEFT", "UPI", "BANK", "INDIA",
         "O/W", "OW", "AV", "AG", "NA", "SERVICES")


def clean_narration(text: Column, max_words: int | None = 8) -> Column:
    """Strip dates, references, amounts, punctuation and bare numbers;
    keep tokens of >= 3 chars with a letter that are not noise; the first
    ``max_words`` (None: all)."""
    t = F.regexp_replace(text, CTX_DATE, " ")
    t = F.regexp_replace(t, CTX_REF, " ")
    t = F.regexp_replace(t, CTX_AMOUNT, " ")
    t = F.regexp_replace(t, r"[|(){}\[\]~_\-=@#$%^&*]", " ")
    t = F.regexp_replace(t, r"\b\d+\b", " ")
    toks = F.filter(F.split(C.strip(t), r"\s+"),
                    lambda x: (F.length(x) >= 3) & x.rlike("[A-Za-z]") & ~F.upper(x).isin(*NOISE))
    out = F.array_join(toks if max_words is None else F.slice(toks, 1, max_words), " ")
    return F.when(C.strip(out) != "", out).otherwise(F.lit("UNKNOWN"))


def context_rows(lines: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A line with a date is a transaction; when it has no amount the
    next one or two lines are searched; amounts below ``context_balance_from``
    are transaction amounts (last one taken), larger ones the balance (negated);
    context = previous + current (+ next when undated) for narration and mode.
    ``reject`` says why a dated line is no transaction (else null).  The
    lines around come from line buckets and their halos, whatever the document's length."""
    ctx_amount = cfg.context_amount_pattern
    d = lines.withColumn("text", C.strip("text")).where(F.col("text") != "")
    d = neighbours(d, ["doc_id"], F.floor(F.col("line_no") / LINE_BUCKET), ["line_no", "text"], "text", 1, 2)
    d = d.withColumnsRenamed({"prev_1": "__p1", "next_1": "__n1", "next_2": "__n2"})
    d = d.withColumn("__date", F.regexp_extract("text", CTX_DATE, 1)).where(F.col("__date") != "")
    has = lambda c: c.rlike(ctx_amount)
    s1 = F.when(has(F.col("text")) | F.col("__n1").isNull(), F.col("text")).otherwise(F.concat_ws(" ", "text", "__n1"))
    s2 = F.when(has(s1) | F.col("__n2").isNull(), s1).otherwise(F.concat_ws(" ", s1, F.col("__n2")))
    amts = F.transform(F.regexp_extract_all(s2, F.lit(ctx_amount), 1),
                       lambda a: F.regexp_replace(a, ",", "").try_cast("double"))
    d = d.withColumn("__amts", F.filter(amts, lambda f: f.isNotNull() & (f > 0.5)))
    d = d.withColumns({"__small": F.filter("__amts", lambda f: f < cfg.context_balance_from),
                       "__large": F.filter("__amts", lambda f: f >= cfg.context_balance_from)})
    ctx = F.concat_ws(" ", F.col("__p1"), F.col("text"),
                      F.when(~F.coalesce(F.col("__n1").rlike(CTX_DATE), F.lit(True)), F.col("__n1")))
    mode = F.upper(F.regexp_extract(ctx, CTX_MODE, 1))
    return d.select(
        "doc_id", "line_no",
        F.regexp_replace(F.col("__date"), r"[./]", "-").alias("date"),
        F.round(F.try_element_at("__small", F.lit(-1)), 2).alias("amount"),
        clean_narration(ctx, cfg.context_narration_words).alias("narration"),
        F.when(F.size("__large") > 0, F.round(-F.try_element_at("__large", F.lit(-1)), 2)).alias("balance"),
        F.when(mode != "", mode).otherwise(F.lit("NEFT")).alias("mode"),
        F.lit("DEBIT").alias("debit_credit"),
        clean_narration(ctx, None).alias("narration_full"), "text",
        F.when(F.size("__amts") == 0, "no amount").when(F.size("__small") == 0, "balance only").alias("reject"))


def parse_context(lines: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The transactions of :func:`context_rows`."""
    return context_rows(lines, cfg).where(F.col("reject").isNull()).drop("reject", "text", "narration_full")


def context_rejects(lines: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Dated lines that are no transaction, with the reason."""
    return context_rows(lines, cfg).where(F.col("reject").isNotNull()).select(
        "doc_id", "line_no", "date", "text", "narration_full", "reject")


def dedupe_first(parsed: DataFrame, order: str = "line_no") -> DataFrame:
    """T13 on line-numbered rows: first row per (doc, amount, balance)."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"__k{c}") for c in ("amount", "balance")]
    first = parsed.select("doc_id", order, *k).groupBy("doc_id", "__kamount", "__kbalance").agg(F.min(order).alias(order))
    return parsed.join(first.select("doc_id", order), ["doc_id", order], "left_semi")


# ---------------------------------------------------------- table headers
# fixed values: five bank header maps (header text -> canonical field)
BANK_MAPS = [
    {"txn date": "date", "transaction date": "date", "value date": "vdate", "narration": "narration",
     "description": "narration", "particulars": "narration", "withdrawal amt.": "debit", "deposit amt.": "credit",
     "closing balance": "balance", "balance": "balance"},
    {"date": "date", "description": "narration", "debit": "debit", "credit": "credit", "balance": "balance"},
    {"transaction date": "date", "transaction remarks": "narration", "debit amount": "debit",
     "credit amount": "credit", "balance (inr)": "balance"},
    {"tran date": "date", "particulars": "narration", "debit": "debit", "credit": "credit", "balance": "balance"},
    {"date": "date", "amount": "amount", "narration": "narration", "balance": "balance", "mode": "mode",
     "withdrawal": "debit", "deposit": "credit"},
]


def bank_map_table(spark) -> DataFrame:
    rows = [(i, h, c) for i, m in enumerate(BANK_MAPS) for h, c in m.items()]
    return spark.createDataFrame(rows, "map_id int, header string, field string")


def header_map(headers: DataFrame) -> DataFrame:
    """Per document, the bank map with the most header hits (earliest map
    on ties); documents with fewer than two hits are rejected.  Returns
    (doc_id, col_idx, field) for the chosen map.  The map table is a literal of
    bounded size (broadcast)."""
    maps = F.broadcast(bank_map_table(headers.sparkSession))
    h = headers.withColumn("header", F.lower(C.strip("header")))
    hits = h.join(maps, "header")
    score = hits.groupBy("doc_id", "map_id").agg(F.count(F.lit(1)).alias("score"))
    best = (score.groupBy("doc_id").agg(F.max_by("map_id", F.struct("score", (-F.col("map_id")).alias("m"))).alias("map_id"),
                                        F.max("score").alias("score"))
            .where(F.col("score") >= 2))
    return hits.join(best.select("doc_id", "map_id"), ["doc_id", "map_id"]).select("doc_id", "col_idx", "field")


DAY_FIRST_FORMATS = ["dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "dd-MM-yy", "dd/MM/yy", "yyyy-MM-dd"]


def parse_dates_day_first(c: Column) -> Column:
    """Six day-first formats in order, then inference."""
    s = C.strip(c.cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in DAY_FIRST_FORMATS],
                      inferred_date(s))


def merge_table_rows(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """T15 (+T16): pivot mapped cells to fields, amount = credit when > 0 else
    debit (side labelled accordingly), defaults, drop rows with neither a date
    nor an amount."""
    m = cells.join(chosen, ["doc_id", "col_idx"])
    g = m.groupBy("doc_id", "row_no").agg(
        *[F.max(F.when(F.col("field") == f, C.strip("cell"))).alias(f)
          for f in ("date", "narration", "debit", "credit", "balance", "amount", "mode")])

    def num(c):
        return F.regexp_replace(F.col(c), r"[^\d.\-]", "").try_cast("double")
    credit, debit = num("credit"), num("debit")
    amount = F.coalesce(num("amount"), F.when(F.coalesce(credit, F.lit(0.0)) > 0, credit).otherwise(debit))
    side = F.when(F.coalesce(credit, F.lit(0.0)) > 0, "CREDIT").otherwise("DEBIT")
    d = g.select("doc_id", "row_no", parse_dates_day_first(F.col("date")).alias("date"), amount.alias("amount"),
                 F.coalesce(F.col("narration"), F.lit("UNKNOWN")).alias("narration"),
                 F.regexp_replace(F.col("balance"), ",", "").try_cast("double").alias("balance"),
                 F.coalesce(F.col("mode"), F.lit("UNKNOWN")).alias("mode"), side.alias("debit_credit"))
    return d.where(F.col("date").isNotNull() | F.col("amount").isNotNull())
