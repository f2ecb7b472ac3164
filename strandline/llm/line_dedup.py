"""Line dedup by a fixed-depth template tree, in DataFrame operations only.

A line's tokens are its runs of non-blanks; a token with a digit is a variable field, ``<*>``.  The tree
has one level for the token count and one for each of the first ``depth`` masked tokens, so a leaf is a
(count, leading tokens) pair.  Inside a leaf, a token that fewer than ``min_docs`` documents have at its
position is a variable field too: what is left is the line's template.  A template is a template of its
documents if at least ``num / den`` of its tokens are constant; else the masked line stands for itself.
A line of ``min_tokens`` tokens or more whose template recurs in ``min_docs`` documents or more is
dropped from all of them but the one with the smallest id, which keeps it.

At scale: lines are counted as 64-bit hashes with map-side partial sums before anything is shuffled, so
a line that a third of all documents hold becomes one row per mapper; token positions are only opened
for distinct masked lines of leaves that could recur, and only beyond the leading tokens, which all lines
of a leaf share.  Counts are written before they are joined back, so that no aggregate sits under a join
and adaptive execution can split a very common line, token or template.  What a document loses comes as a
bitmap of its lines.

Nulls: a null text has no lines and stays null; rows with a null id count for nothing and keep all their
lines.  Blank lines are kept.  Rows that repeat an id count as one document if their texts are equal.
An empty table gives an empty result.  Other columns pass through, whatever their names, except that the
names this operator makes (``n_lines``, ``n_dropped``, and the text itself) replace input columns of those
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._common import Scratch, shielded

#: Blanks between tokens that aren't single spaces, and a token that holds a digit.
ODD_BLANKS = r"[ \t\f\r\x0B]{2,}|[\t\f\r\x0B]"
WITH_DIGIT = r"(?<![^ \t\f\r\x0B\n])[^ \t\f\r\x0B\n0-9]*+[0-9][^ \t\f\r\x0B\n]*+"
WILD = "<*>"
#: Words of 64 bits in the filter that keeps texts out of a second parse.
FILTER_WORDS = 1 << 16


def masked(text: Column) -> Column:
    """A text whose lines have single blanks and whose digit-bearing tokens are masked."""
    return F.regexp_replace(F.regexp_replace(text, WITH_DIGIT, WILD), ODD_BLANKS, " ")


def _lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    """One row per line that may be dropped: doc, version of its text, line number, masked line."""
    line = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split(masked(F.col("text")), "\n")).alias("line_no", "raw"))
    shape = line.select("doc_id", "version", "line_no", F.trim("raw").alias("shape"))
    return shape.where(F.substring_index("shape", " ", min_tokens - 1) != F.col("shape"))


def dedup_lines(docs: DataFrame, depth: int = 3, min_docs: int = 3, min_tokens: int = 4, num: int = 7, den: int = 10) -> DataFrame:
    """The input's columns with recurring lines cut from ``text``, and ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    columns, docs = docs.columns, shielded(docs, "doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    # every line as hashes, parsed once; distinct masked lines with their documents
    blanks = F.length("shape") - F.length(F.replace("shape", F.lit(" "), F.lit("")))
    line = _lines(texts, min_tokens).select("doc_id", "version", "line_no", F.xxhash64("shape").alias("h"), F.xxhash64(blanks, F.substring_index("shape", " ", depth)).alias("leaf"))
    hashed = scratch.keep(line, "hashes")
    once = hashed.groupBy("h", "leaf", "doc_id").agg(F.lit(1).alias("one"))
    shapes = scratch.keep(once.groupBy("h", "leaf").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc")), "shapes")
    leaves = shapes.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count(F.lit(1)).alias("n")).where((F.col("leaf_docs") >= min_docs) & (F.col("n") > 1)).select("leaf")

    # leaves with several lines: their lines are read again, from the first document of each
    opened = scratch.keep(shapes.join(leaves, "leaf", "left_semi"), "open")
    word, bit = "pmod(shiftright(xxhash64(doc_id), 6), {0})", "cast(pmod(xxhash64(doc_id), 64) as int)"
    # a filter of fixed size skips most other documents; the join on the line's hash is what decides
    wanted = opened.select(F.col("first_doc").alias("doc_id")).groupBy(F.expr(word.format(FILTER_WORDS)).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("m"))
    maybe = texts.join(F.broadcast(wanted), F.expr(word.format(FILTER_WORDS)) == F.col("w")).where(F.expr(f"getbit(m, {bit}) = 1"))
    found = _lines(maybe.select("doc_id", "text"), min_tokens).select(F.xxhash64("shape").alias("h"), "shape")
    text_of = found.join(opened.select("h"), "h", "left_semi").groupBy("h").agg(F.first("shape").alias("shape"))
    # the leading tokens are constant in all of a leaf; counted here, once a line and not once a token
    token = F.split("shape", " ")
    lead = F.size(F.filter(F.slice(token, 1, depth), lambda x: x != WILD))
    placed = scratch.keep(opened.join(text_of, "h").select("h", "leaf", "docs", "first_doc", F.size(token).alias("n"), lead.alias("lead"), F.slice(token, depth + 1, 1 << 30).alias("rest")), "placed")

    # constants and variable fields by position
    cells = placed.select("h", "leaf", "docs", "first_doc", "n", "lead", F.posexplode_outer("rest").alias("at", "token"))
    often = scratch.keep(cells.where("at is not null").groupBy("leaf", "at", "token").agg(F.sum("docs").alias("have")).where(F.col("have") >= min_docs), "often")
    marked = cells.join(often, ["leaf", "at", "token"], "left").withColumn("const", F.col("have").isNotNull() & (F.col("token") != WILD))
    # the template as an order-free sum of the hashes of its constants: no line's tokens need to meet in order
    sums = marked.groupBy("h", "leaf", "docs", "first_doc", "n").agg(
        (F.max("lead") + F.sum(F.coalesce("const", F.lit(False)).cast("long"))).alias("n_const"),
        F.sum(F.when(F.col("const"), F.xxhash64("at", "token").cast("decimal(38,0)"))).alias("s1"),
        F.sum(F.when(F.col("const"), F.xxhash64("token", "at", F.lit(1)).cast("decimal(38,0)"))).alias("s2"),
    )
    general = sums.select("h", "docs", "first_doc", F.when(F.col("n_const") * den >= F.col("n") * num, F.xxhash64("leaf", "n", "s1", "s2")).otherwise(F.col("h")).alias("template"))
    alone = shapes.where(F.col("docs") >= min_docs).join(opened.select("h"), "h", "left_anti").select("h", "docs", "first_doc", F.col("h").alias("template"))
    all_shapes = general.unionByName(alone)
    # documents of a template: the sum over its lines is exact for one line, and for several it is counted below
    by_template = all_shapes.groupBy("template").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("n"), F.min("first_doc").alias("first_of")).where(F.col("docs") >= min_docs)
    member = scratch.keep(all_shapes.select("h", "template").join(by_template, "template"), "members")
    hits = scratch.keep(hashed.join(member, "h").select("doc_id", "version", "line_no", "template", "n", "first_of"), "hits")
    several = hits.where("n > 1").groupBy("template", "doc_id").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("real"))
    few = scratch.keep(several.where(F.col("real") < min_docs).select("template"), "few")
    gone = hits.where("doc_id > first_of").join(few, "template", "left_anti")
    words = gone.groupBy("doc_id", "version", F.floor(F.col("line_no") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(line_no % 64 as int))")).alias("bits"))
    of_doc = words.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"), F.max("word").alias("last"), F.sum(F.bit_count("bits")).cast("long").alias("lost"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("long")))
    drops = scratch.keep(of_doc.select("doc_id", "version", dense.alias("gone"), "lost"), "drops")

    key = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__version": F.xxhash64("text")})
    joined = key.join(drops.toDF("__d", "__v", "__gone", "__lost"), (F.col("__doc") == F.col("__d")) & (F.col("__version") == F.col("__v")), "left")
    zero = F.lit(0).cast("long")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: F.getbit(F.coalesce(F.get("__gone", F.floor(i / 64).cast("int")), zero), i % 64) == 0), "\n")
    count = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    own = {i: c for i, c in enumerate(columns) if c.lower() not in ("n_lines", "n_dropped")}
    named = [text.alias("text") if c == "text" else F.col("doc_id" if c == "doc_id" else f"__c{i}").alias(c) for i, c in own.items()]
    return joined.select(*named, F.coalesce(count, zero).alias("n_lines"), F.coalesce("__lost", zero).alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of ``documents``; the text that is kept is returned as its digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB's answer for op3_line_dedup.
OP3_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(12) || chr(13) || chr(11)) AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)
), shaped AS (
  SELECT doc_id, i, regexp_replace(regexp_replace(l, '[^ \t\f\r\x0B]*[0-9][^ \t\f\r\x0B]*', '<*>', 'g'), '[ \t\f\r\x0B]+', ' ', 'g') AS shape FROM line
), tok AS (
  SELECT doc_id, i, shape, string_split(shape, ' ') AS t FROM shaped
), ok AS (
  SELECT doc_id, i, shape, t, len(t) AS n, t[1:3] AS lead FROM tok WHERE len(t) >= 4
), shapes AS (
  SELECT shape, n, lead, any_value(t) AS t, count(DISTINCT doc_id) AS docs FROM ok GROUP BY ALL
), leaves AS (
  SELECT n, lead FROM shapes GROUP BY ALL HAVING sum(docs) >= 3 AND count(*) > 1
), cells AS (
  SELECT shape, n, lead, docs, p, t[p] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM shapes SEMI JOIN leaves USING (n, lead))
), often AS (
  SELECT n, lead, p, token FROM cells GROUP BY ALL HAVING sum(docs) >= 3
), marked AS (
  SELECT c.shape, c.n, c.lead, c.p, CASE WHEN o.token IS NOT NULL AND c.token <> '<*>' THEN c.token END AS const
  FROM cells c LEFT JOIN often o ON o.n = c.n AND o.lead = c.lead AND o.p = c.p AND o.token = c.token
), general AS (
  SELECT shape, CASE WHEN count(const) * 10 >= n * 7 THEN 'T' || n || ' ' || string_agg(coalesce(const, '<*>'), ' ' ORDER BY p) ELSE 'S' || shape END AS template FROM marked GROUP BY shape, n, lead
), named AS (
  SELECT ok.doc_id, ok.i, coalesce(template, 'S' || ok.shape) AS template FROM ok LEFT JOIN general USING (shape)
), drops AS (
  SELECT template, min(doc_id) AS first_of FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= 3
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS g FROM named JOIN drops USING (template) WHERE doc_id > first_of GROUP BY doc_id
), kept AS (
  SELECT raw.doc_id, len(ls) AS n, coalesce(len(g), 0) AS d,
         CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text
  FROM raw LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(d AS BIGINT) AS n_dropped, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""
