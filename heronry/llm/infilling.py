r"""Fill-in-the-middle transformation by escaped marker injection, in DataFrame expressions alone.

A text is cut into units, here lines with their line end. The delimiter U+0001 is escaped in the text (U+0002 is the escape
character), appended after every unit by one regexp_replace and counted; substring_index then takes the parts up to a rank, between
two ranks and after a rank, and what is taken loses its delimiters and is unescaped. Nothing is shuffled and no text is exploded, so
a row costs its own length and nothing else.

Where a text is cut and how it is laid out follows from a SHA-256 of seed and doc_id, so a run can be repeated and split at will.
Each text becomes `<P>`prefix`<S>`suffix`<M>`middle (psm), `<S>`suffix`<P>`prefix`<M>`middle (spm), or stays as it is (plain): empty
texts, texts that contain a marker, and the share that `rate` leaves out. `restored` goes back from output and form to the text.

Null text counts as empty; a null doc_id is hashed as an empty string; repeated rows give repeated rows; texts of any length and with
any characters, the delimiter and the escape character too, come back exactly; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import id_and_text, table

DELIMITER, ESCAPE = "\x01", "\x02"
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50


def escaped(text: Column) -> Column:
    """text without any delimiter."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}b")), F.lit(DELIMITER), F.lit(f"{ESCAPE}a"))


def unescaped(part: Column) -> Column:
    """The text that a part of a marked text stands for."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}a"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}b"), F.lit(ESCAPE))


def marked(text: Column, unit: str = UNIT) -> Column:
    """text, escaped, with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), unit, f"$0{DELIMITER}")


def n_units(marks: Column) -> Column:
    return F.octet_length(marks) - F.octet_length(F.replace(marks, F.lit(DELIMITER), F.lit("")))


def _upto(marks: Column, rank: Column) -> Column:
    return F.call_function("substring_index", marks, F.lit(DELIMITER), rank.cast("int"))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from: its markers can't stand in any part, so each is found once."""
    before = lambda text, mark: F.call_function("substring_index", text, F.lit(mark), F.lit(1))
    after = lambda text, mark: F.call_function("substring_index", text, F.lit(mark), F.lit(-1))
    between = lambda first, last: after(before(output, last), first)
    psm = F.concat(between(PREFIX, SUFFIX), after(output, MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(output, MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infilled(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = UNIT) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null where plain) and output of every row."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = id_and_text(docs).select("doc_id", "text", marked(F.col("text"), unit).alias("marks"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    counted = rows.withColumn("n", n_units(F.col("marks")).cast("long"))
    ends = counted.withColumn("x", F.col("h1") % (F.col("n") + 1)).withColumn("y", F.col("h2") % (F.col("n") + 1))
    kept = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (F.col("h3") % 100 >= rate)
    form = F.when(kept, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    head = _upto(F.col("marks"), high)
    parts = {"prefix": _upto(F.col("marks"), low), "middle": _upto(head, low - high), "suffix": _upto(F.col("marks"), high - F.col("n") - 1)}
    formed = ends.withColumn("form", form)
    cut = formed.select("doc_id", "text", "n", "form", *[F.when(F.col("form") != "plain", unescaped(part)).alias(name) for name, part in parts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return cut.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, cuts and digests of every document's output and of the text rebuilt from it."""
    rows = infilled(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents),
h AS (
  SELECT *, len(units) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
         array_to_string(list_slice(units, b + 1, n), '') AS suffix
  FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
