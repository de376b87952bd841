"""Cross-site boilerplate lines by distinct-site spread. DataFrame functions only.

For each line hash a HyperLogLog sketch of its sites is built by aggregation; sketches merge
map side and after the shuffle. Lines whose estimate lies near the threshold get an exact
distinct count; then lines on enough sites are taken out of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.plans.materialise import HOT_SHARE, digest_key, free_name, materialise

#: log2 of the sketches' registers: a standard error of about 1.04 / sqrt(4096), 1.6 %.
SKETCH_BITS = 12
#: Estimates within this share of the threshold (some six standard errors), or within 2 sites of it, are counted exactly.
NEAR = 0.1


def document_lines(docs: DataFrame, *, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc_key, doc_id, site, pos, line_key) of each line with more than white space; the key is of the trimmed line.

    doc_key is a hash of id and text, so that rows which repeat an id with another text stay apart.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), digest_key(F.col(id_col), F.col(text_col)).alias("doc_key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.col(text_col).alias("text"))
    rows = keyed.select("doc_id", "doc_key", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))  # the key is made before, once a text
    line = F.btrim("line", F.lit(" \t\n\u000b\f\r"))
    return rows.select("doc_key", "doc_id", "site", "pos", line.alias("line")).where("line <> ''").select("doc_key", "doc_id", "site", "pos", F.unhex(F.md5("line")).alias("line_key"))


def spread(lines: DataFrame, min_sites: int, near: float = NEAR) -> DataFrame:
    """(line_key, n, first_key, first_pos, sites, exact) of lines on min_sites or more distinct sites.

    A line seen fewer than min_sites times can't reach them and leaves after the first
    aggregation. sites is the sketch's estimate, or the exact count where exact is true.
    """
    found = materialise(
        lines.groupBy("line_key")
        .agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "doc_key", "pos")).alias("first"))
        .where(F.col("n") >= min_sites)
        .select("line_key", "n", F.col("first.doc_key").alias("first_key"), F.col("first.pos").alias("first_pos"), F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - near) - 2)
    )
    unsure = F.abs(F.col("sites") - min_sites) <= F.greatest(F.lit(2.0), F.lit(min_sites * near))
    sure = found.where(~unsure & (F.col("sites") >= min_sites)).withColumn("exact", F.lit(False))
    close = materialise(found.where(unsure))
    some = keyed(lines.select("line_key", "site"), close, "line_key", "n").select("line_key", "site").distinct()
    counts = some.groupBy("line_key").agg(F.count("*").alias("exact_sites"))
    exact = close.join(counts, "line_key").where(F.col("exact_sites") >= min_sites).select("line_key", "n", "first_key", "first_pos", F.col("exact_sites").alias("sites"), F.lit(True).alias("exact"))
    return sure.unionByName(exact)


def keyed(lines: DataFrame, keys: DataFrame, key: str, size: str) -> DataFrame:
    """Lines whose key is among keys (with n, the lines of each). The keys of over 1 / HOT_SHARE of the lines are fewer than HOT_SHARE, so they are broadcast; the others shuffle."""
    total = keys.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot, cold = keys.where(F.col(size) > total / HOT_SHARE), keys.where(F.col(size) <= total / HOT_SHARE)
    return lines.join(F.broadcast(hot), key).unionByName(lines.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def remove_boilerplate(docs: DataFrame, *, min_sites: int = 8, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with text_col stripped of lines that stand on min_sites or more sites, and n_lines, n_removed.

    Lines count as equal when identical without outer ASCII white space; blank lines stay.
    With keep_first the first occurrence (smallest id, then text's key, then position) of each such line stays,
    so that no passage is lost from the corpus. A null site is a site of its own, named ''; a
    null text stays null and has no lines. Rows that repeat id and text are treated alike. All
    columns of docs stay, whatever their names; n_lines and n_removed replace columns of these names. Whole texts are
    read, and the cost of a text is in proportion to its lines. An empty table gives an empty
    result.
    """
    lines = materialise(document_lines(docs, id_col=id_col, text_col=text_col, site_col=site_col))
    wide = materialise(spread(lines, min_sites))
    marked = keyed(lines.select("doc_key", "doc_id", "pos", "line_key"), wide, "line_key", "n")
    if keep_first:
        marked = marked.where(~(F.col("doc_key").eqNullSafe(F.col("first_key")) & (F.col("pos") == F.col("first_pos"))))
    rest = docs.drop("n_lines", "n_removed")
    key, n, flags = (free_name(rest, c) for c in ("key", "n", "flags"))
    gone = marked.groupBy("doc_key").agg(F.sort_array(F.collect_set("pos")).alias("gone")).select(F.col("doc_key").alias(key), F.size("gone").alias(n), gone_flags(F.col("gone")).alias(flags))
    lines_in = F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1
    kept = F.zip_with(F.split(text_col, "\n"), F.col(flags), lambda line, out: F.when(F.coalesce(out, F.lit(False)), F.lit(None)).otherwise(line))
    text = F.when(F.col(n).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))  # which skips nulls
    joined = rest.join(gone, digest_key(F.col(id_col), F.col(text_col)) == F.col(key), "left")
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in rest.columns], F.when(F.col(text_col).isNull(), 0).otherwise(lines_in).cast("long").alias("n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("n_removed"))


def gone_flags(gone: Column) -> Column:
    """A boolean for each line up to the last in gone (sorted positions): whether it is gone. Built from the gaps between them, so its cost is that of its length."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.size(gone) - 1))
    return F.flatten(F.zip_with(before, gone, lambda a, b: F.array_append(F.array_repeat(F.lit(False), b - a - 1), F.lit(True))))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars, text_md5) per row of docs after remove_boilerplate, which tells what becomes of nulls and repeated rows; here a null text counts as empty."""
    done = remove_boilerplate(docs.select("doc_id", "text", "source"), **options)
    return done.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
