"""Queries of this subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import canonical, history, lexicon, names, packing, splitting


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def typed_names(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct string of the three columns of names."""
    register, docs = _t(spark, d, "invoice_register"), _t(spark, d, "documents")
    both = register.select(F.explode(F.array_distinct(F.array("supplier", "customer"))).alias("name"))
    return both.unionByName(docs.select(F.col("vendor").alias("name"))).where("name IS NOT NULL").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.link(typed_names(spark, d)))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per string that names somebody: its entity and the entity's number of spellings."""
    linked = names.link(typed_names(spark, d))
    return linked.join(linked.groupBy("entity").agg(F.count("*").alias("spellings")), "entity")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(history.documents(_t(spark, d, "documents"), _t(spark, d, "extracted_invoices")))


REGISTER = ["invoice_no", "supplier", "customer", "invoice_date", "po_number", "amount", "status"]
EXTRACTED = ["vendor_name", "invoice_number", "purchase_order", "invoice_date", "currency", "total_due"]


def records(spark: SparkSession, d: str) -> DataFrame:
    """(source_table, id, digest, canon) of the three tables."""
    register = canonical.records_of_columns(_t(spark, d, "invoice_register"), "row_id", [F.col(c) for c in REGISTER])
    extracted = canonical.records_of_columns(_t(spark, d, "extracted_invoices"), "invoice_id", [F.col(f"{c}.value").alias(c) for c in EXTRACTED])
    exports = canonical.records_of_json(_t(spark, d, "invoice_exports"), "rec_id", "record")
    named = [df.select(F.lit(n).alias("source_table"), "id", "digest", "canon") for n, df in (("invoice_register", register), ("extracted_invoices", extracted), ("invoice_exports", exports))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies(records(spark, d))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record once, by its first id, with the number of rows it stands for."""
    return canonical.groups(records(spark, d)).select("source_table", "first_id", F.col("n").alias("copies"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.encode_corpus(_t(spark, d, "documents"))


def _budgets(spark: SparkSession, d: str, *columns: str) -> list[tuple]:
    """The table of token budgets: a fixed setting of four rows."""
    return [tuple(r) for r in _t(spark, d, "token_budgets").select("budget_id", "tokenizer", *columns).orderBy("budget_id").collect()]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_corpus(_t(spark, d, "documents"), _budgets(spark, d, "capacity_tokens"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_t(spark, d, "documents"), _budgets(spark, d, "piece_limit_tokens", "overlap_tokens"))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p4_found": p4_found, "p5_found": p5_found, "p5_records": p5_records, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_pieces": p8_pieces}
def _norm(x: str) -> str:
    """Letters and digits in one case; the ligature has no upper case in DuckDB, so it is spelled out."""
    return rf"regexp_replace(lower(replace(coalesce({x}, ''), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _fields(columns: list[str]) -> str:
    return "concat_ws(chr(31), " + ", ".join(_norm(c) for c in columns) + ")"


_RECORDS = f"""r as (select 'invoice_register' source_table, row_id id, {_fields(REGISTER)} c from invoice_register union all
    select 'extracted_invoices', invoice_id, {_fields([c + ".value" for c in EXTRACTED])} from extracted_invoices union all
    select 'invoice_exports', rec_id, array_to_string(list_sort(list_transform(json_keys(record), lambda k: concat({_norm("k")}, chr(31), {_norm("json_extract_string(record, concat('$.\"', k, '\"'))")}))), chr(30)) from invoice_exports)"""

ORACLES: dict[str, str] = {
    "p5_found": f"with {_RECORDS}, g as (select *, min(id) over (partition by source_table, c) first_id from r) select source_table, first_id, id as copy_id from g where id <> first_id",
    "p5_records": f"with {_RECORDS} select source_table, min(id) as first_id, count(*) as copies from r group by source_table, c",
}
