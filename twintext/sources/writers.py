"""Writers of exchange formats as lines of text, one unit or row each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintext.functions.text import csv_cell
from twintext.stages import materialise


def xml_escape(text: Column) -> Column:
    """XML text: characters that XML can't hold are dropped, markup is escaped."""
    legal = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        legal = F.replace(legal, F.lit(mark), F.lit(entity))
    return legal


#: Attributes of units that a client may see.
CLIENT_ATTRS = ("domain", "subject")


def tmx_units(variants: DataFrame, langs: tuple[str, ...] = (), attrs: bool = False, for_client: bool = False) -> DataFrame:
    """Live units (tu_id, uuid, deleted, lang, plain, and attrs, a map) as TMX elements, in order of tu_id.

    With ``attrs`` units carry their attributes as properties; for a client
    only those of ``CLIENT_ATTRS``.
    """
    live = variants.where("not deleted")
    live = live.where(F.col("lang").isin(*langs)) if langs else live
    tuv = F.concat(F.lit('<tuv xml:lang="'), xml_escape(F.col("lang")), F.lit('"><seg>'), xml_escape(F.col("plain")), F.lit("</seg></tuv>"))
    props = F.lit("")
    if attrs:
        entries = F.array_sort(F.map_entries("attrs"))
        entries = F.filter(entries, lambda e: e["key"].isin(*CLIENT_ATTRS)) if for_client else entries
        props = F.array_join(F.transform(entries, lambda e: F.concat(F.lit('<prop type="'), xml_escape(e["key"]), F.lit('">'), xml_escape(e["value"]), F.lit("</prop>"))), "")
    rows = live.select("tu_id", "uuid", F.struct("lang", tuv.alias("x"), props.alias("props")).alias("v"))
    units = rows.groupBy("tu_id", "uuid").agg(F.array_sort(F.collect_list("v")).alias("v"))
    body = F.concat(F.element_at("v", 1)["props"], F.array_join(F.transform("v", lambda v: v["x"]), ""))
    return units.select("tu_id", F.concat(F.lit('<tu tuid="'), xml_escape(F.col("uuid")), F.lit('">'), body, F.lit("</tu>")).alias("value"))


def write_tmx(variants: DataFrame, path: str, langs: tuple[str, ...] = (), src_lang: str = "*all*", attrs: bool = False, for_client: bool = False) -> None:
    """A folder of TMX files, sorted by unit over the files; each is whole, with header and footer."""
    units = tmx_units(variants, langs, attrs, for_client).orderBy("tu_id").select("value")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header creationtool="twintext" creationtoolversion="1" segtype="sentence" o-tmf="twintext" adminlang="en" srclang="{src_lang}" datatype="plaintext"/><body>'

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([*[head] * (not begun), *lines], pa.string())], names=["value"])
            begun = True
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(["</body></tmx>"])], names=["value"])

    units.mapInArrow(framed, "value string").write.text(path)


def glossary_rows(entries: DataFrame) -> DataFrame:
    """Renderings (term_id, term, lang, rendering, forbidden, preferred) with a running concept number and a status.

    Concepts are numbered in two steps: within ranges of ids, and by the
    number of concepts in the ranges before.
    """
    concepts = entries.select("term_id").distinct().repartitionByRange("term_id").withColumn("__part", F.spark_partition_id())
    concepts = materialise(concepts, "concepts")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    starts = concepts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).withColumn("__start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranks = concepts.join(F.broadcast(starts), "__part").withColumn("concept", F.col("__start") + F.row_number().over(Window.partitionBy("__part").orderBy("term_id"))).drop("__part", "__start")
    status = F.when(F.col("forbidden"), "forbidden").when(F.col("preferred"), "preferred").otherwise("allowed")
    return entries.join(ranks, "term_id").select("concept", "term", "lang", "rendering", status.alias("status"))


def tbx_entries(rows: DataFrame, src_lang: str) -> DataFrame:
    """Glossary rows as TBX entries, one line for each concept."""
    note = F.when(F.col("status") == "forbidden", "deprecatedTerm-admn-sts").when(F.col("status") == "preferred", "preferredTerm-admn-sts").otherwise("admittedTerm-admn-sts")
    lang = F.concat(F.lit('<langSet xml:lang="'), xml_escape(F.col("lang")), F.lit('"><tig><term>'), xml_escape(F.col("rendering")), F.lit('</term><termNote type="administrativeStatus">'), note, F.lit("</termNote></tig></langSet>"))
    each = rows.select("concept", "term", F.struct("lang", "rendering", lang.alias("x")).alias("v")).groupBy("concept", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["x"]), "").alias("body"))
    source = F.concat(F.lit(f'<langSet xml:lang="{src_lang}"><tig><term>'), xml_escape(F.col("term")), F.lit("</term></tig></langSet>"))
    return each.select("concept", F.concat(F.lit('<termEntry id="c'), F.col("concept").cast("string"), F.lit('">'), source, "body", F.lit("</termEntry>")).alias("value"))


#: Columns of a ledger file, in order.
LEDGER = ("assignment_id", "vendor_id", "client_id", "words", "currency", "amount", "delivered_on", "paid_on", "days_to_pay", "status")


def ledger_csv(lines: DataFrame) -> DataFrame:
    """Lines of a ledger file with its ten columns; the sink ends them with CRLF."""
    return csv_lines(lines, list(LEDGER))


def tenant_audit(log: DataFrame, tenant_id: int) -> DataFrame:
    """A tenant's whole log as JSON lines, in order of the id."""
    return log.where(F.col("tenant_id") == tenant_id).select("id", F.to_json(F.struct(*log.columns)).alias("value")).orderBy("id").select("value")


def client_units(variants: DataFrame, most: int = 100_000) -> DataFrame:
    """Units for a client; more than ``most`` are refused rather than cut."""
    if variants.where("not deleted").select("tu_id").distinct().limit(most + 1).count() > most:
        raise ValueError(f"a client's resource has at most {most} units")
    return tmx_units(variants, attrs="attrs" in variants.columns, for_client=True)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as CSV lines whose cells no spreadsheet takes for formulas."""
    return rows.select(F.array_join(F.array(*[F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in columns]), ",").alias("value"))
