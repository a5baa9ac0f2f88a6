"""Files as a source and a sink: every document is written as a file of some kind, and the folder is read back.

A document's words, twelve a line, are the lines of its file; its kind goes round by id. The SQL says what each format's reader must return.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.plans.catalog import register
from quillstone.session import cut, remove, shared_dir
from quillstone.sources import document
from quillstone.sources.encode import ENCODERS, PAGE
from quillstone.sources.tables import table

KINDS = list(ENCODERS)
WORDS = 12
#: Texts that one task makes into files, whatever parts the table comes in.
TEXTS = 2000


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    # a table's parts may be few and large, and making a file takes milliseconds
    docs = docs.repartition(max(spark.sparkContext.defaultParallelism, -(-docs.count() // TEXTS)), "doc_id").withColumn("w", F.expr(r"regexp_extract_all(text, '([^\\s\\p{Z}\\p{Cc}]+)', 1)"))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / WORDS).cast("int")), lambda i: F.array_join(F.slice("w", i * WORDS + 1, F.lit(WORDS)), " "))
    content = F.when(F.size("w") > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    return docs.select(F.col("doc_id").cast("string").alias("name"), kind.alias("kind"), content.alias("content"))


def _written(spark, sf_dir, read):
    """What ``read`` makes of a folder with all documents as files; the folder goes when it is done."""
    document.register(spark)
    folder = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    try:
        _lines(spark, sf_dir).write.format("document").mode("append").save(folder)
        return cut(read(folder))
    finally:
        remove(spark, folder)


def _reader(spark):
    """Files of a text each: about a thousand a task, as each takes milliseconds."""
    return spark.read.format("document").option("open", 64 << 10)


_NAME = r"cast(regexp_extract(path, '/([0-9]+)[.][a-z]+$', 1) as long) as doc_id"
_EXPECTED = f"""with w as (select doc_id, {KINDS}[1 + doc_id % {len(KINDS)}] kind, regexp_extract_all(text, '[^\\s\\pZ\\p{{Cc}}]+') w from documents where text is not null),
l as (select *, list_transform(range(0, (len(w) + {WORDS - 1}) // {WORDS}), lambda i: array_to_string(w[i * {WORDS} + 1 : i * {WORDS} + {WORDS}], ' ')) ln from w),
p as (select *, array_to_string(ln[p * {PAGE} + 1 : p * {PAGE} + {PAGE}], chr(10)) pl from (select *, unnest(range(0, (len(ln) + {PAGE - 1}) // {PAGE})) p from l)),
c as (select doc_id, kind, i + 1 as i, ln[i + 1] x from (select *, unnest(range(0, len(ln))) i from l where kind = 'docx')),
x as (select doc_id, kind, '| ' || array_to_string(list_transform(range(0, len(ln)), lambda i: array_to_string(list_concat(w[i * {WORDS} + 1 : i * {WORDS} + {WORDS}],
  list_transform(range(0, least({WORDS}, len(w)) - len(w[i * {WORDS} + 1 : i * {WORDS} + {WORDS}])), lambda j: '')), ' | ')), ' |' || chr(10) || '| ') || ' |' t, repeat(' --- |', least({WORDS}, len(w))) rule from l where kind = 'xlsx' and len(w) > 0),
e as (
  select doc_id, kind, 1 number, case kind when 'txt' then 'text' else 'page' end part, array_to_string(ln, chr(10)) content from l where kind in ('txt', 'html') and len(w) > 0
  union all select doc_id, kind, p + 1, 'page', pl from p where kind in ('epub', 'pdf')
  union all select doc_id, kind, i, 'paragraph', x from c
  union all select doc_id, kind, p + 1, 'title', 'Part ' || (p + 1) from p where kind = 'pptx'
  union all select doc_id, kind, p + 1, 'text', pl from p where kind = 'pptx'
  union all select doc_id, kind, 1, 'sheet', case when contains(t, chr(10)) then regexp_replace(t, chr(10), chr(10) || '|' || rule || chr(10)) else t || chr(10) || '|' || rule end from x
  union all select doc_id, kind, 1, 'header', 'From: sender@example.org' || chr(10) || 'To: reader@example.org' || chr(10) || 'Subject: Document ' || doc_id from l where kind = 'eml'
  union all select doc_id, kind, 2, 'body', array_to_string(ln, chr(10)) from l where kind = 'eml' and len(w) > 0),
rd as (select doc_id, kind, number, part, content, null as error from e union all select doc_id, kind, null, null, null, 'no content' from l where len(w) = 0 and kind <> 'eml')"""


@register("document_files", _EXPECTED + " select doc_id, kind, number, part, length(content) chars, substr(sha256(content), 1, 16) hash, error from rd")
def document_files(spark, sf_dir):
    """A row for each page, slide, sheet, paragraph and mail part."""
    read = lambda folder: _reader(spark).load(folder).select(F.expr(_NAME), "kind", "number", "part", F.length("content").cast("long").alias("chars"), F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16).alias("hash"), "error")
    return _written(spark, sf_dir, read)


@register("document_kinds", _EXPECTED + " select kind, count(distinct doc_id) files, count(content) parts, sum(length(content))::bigint chars from rd where kind in ('pdf', 'docx') group by kind")
def document_kinds(spark, sf_dir):
    """Two kinds of files only: the others are left out of the list and never opened."""

    def read(folder):
        rows = _reader(spark).load(folder).where("kind in ('pdf', 'docx')")
        return rows.groupBy("kind").agg(F.countDistinct("path").alias("files"), F.count("content").alias("parts"), F.sum(F.length("content").cast("long")).alias("chars"))

    return _written(spark, sf_dir, read)


@register("document_list", "select count(*) files, count(distinct doc_id) names from documents where text is not null")
def document_list(spark, sf_dir):
    """A list by path and size opens no file."""
    read = lambda folder: _reader(spark).schema("path string, size long").load(folder).where("size >= 0").agg(F.count("*").alias("files"), F.countDistinct("path").alias("names"))
    return _written(spark, sf_dir, read)
