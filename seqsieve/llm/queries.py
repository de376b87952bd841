"""Queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.llm import line_quality
from seqsieve.llm.alignment import align_documents
from seqsieve.llm.exact_dedup import exact_owners
from seqsieve.llm.html_extract import extract_pages, train
from seqsieve.llm.labelled_pages import labelled_pages
from seqsieve.llm.licenses import scan
from seqsieve.llm.line_dedup import line_report
from seqsieve.llm.merkle import verified
from seqsieve.llm.packing import pack
from seqsieve.llm.ppm import score_documents
from seqsieve.llm.quality import judge
from seqsieve.llm.sentencepiece_sa import digest
from seqsieve.llm.simhash_golay import near_duplicates
from seqsieve.llm.url_filter import fit, judge_urls, labelled_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(maxsize=1)
def page_model() -> tuple:
    """The extraction model, fitted once in a driver's life."""
    return train(labelled_pages())


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_model())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), temperature=0.5)  # small sources get more than the corpus's share while they last
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window")


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit(labelled_table(spark)), URL_RULES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_owners(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest held against documents of which those with an even CRC-32 of their id have lost their line breaks."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verified(documents(spark, sf_dir), altered={"text": tampered})


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_html": op1_html,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_ppm": op8_ppm,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_licenses": op10_licenses,
    "op11_merkle": op11_merkle,
    "op12_line_quality": op12_line_quality,
    "op13_alignment": op13_alignment,
}

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Unsigned CRC-32 of a decimal doc_id: a step for each bit, at whose start a byte is mixed in.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))))"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


#: What the leaf of a document hashes, with a place for its text.
LEAF = " || ".join([*(_field(f"d.{c}") for c in ("doc_id", "source", "lang", "n_chars")), _field("{0}")])

ORACLES = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
trimmed AS (SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM lines),
wide AS (
  SELECT line, min((doc_id, pos)) AS first FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8),
marked AS (
  SELECT t.doc_id, t.pos, t.raw, (w.line IS NOT NULL AND w.first <> (t.doc_id, t.pos)) AS gone
  FROM trimmed t LEFT JOIN wide w ON t.line = w.line),
done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed,
       coalesce(length(o.text), 0) AS n_chars, md5(coalesce(o.text, '')) AS text_md5
FROM documents d LEFT JOIN done o USING (doc_id)""",
    "op6_exact_dedup": f"""
WITH t AS (SELECT doc_id, {ASCII_LOWER.format("coalesce(text, '')")} AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""",
    "op11_merkle": f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, {CRC32} AS crc FROM documents),
base AS (
  SELECT d.doc_id, d.source AS grp, sha256({LEAF.format("d.text")}) AS leaf,
         sha256({LEAF.format("replace(d.text, chr(10), '')")}) AS changed, crc % 2 = 0 AS tampered
  FROM documents d JOIN crc USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM base),
up AS (
  SELECT grp, 0 AS lvl, idx, n, leaf AS h FROM ranked
  UNION ALL
  SELECT grp, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY grp, lvl, idx // 3, (n + 2) // 3),
subroots AS (
  SELECT grp, lvl AS height, h AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos AS idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 3, (n + 2) // 3),
others AS (
  SELECT r.doc_id, u.lvl AS step, u.idx < r.idx // (3 ** u.lvl)::BIGINT AS before, u.idx, u.h
  FROM ranked r JOIN up u ON r.grp IS NOT DISTINCT FROM u.grp AND u.n > 1 AND u.idx // 3 = r.idx // (3 ** (u.lvl + 1))::BIGINT AND u.idx <> r.idx // (3 ** u.lvl)::BIGINT
  UNION ALL
  SELECT r.doc_id, s.height + t.lvl, t.idx < s.pos // (3 ** t.lvl)::BIGINT, t.idx, t.h
  FROM ranked r JOIN subroots s ON r.grp IS NOT DISTINCT FROM s.grp
  JOIN top t ON t.n > 1 AND t.idx // 3 = s.pos // (3 ** (t.lvl + 1))::BIGINT AND t.idx <> s.pos // (3 ** t.lvl)::BIGINT),
heights AS (
  SELECT r.doc_id, s.subroot, s.height + (SELECT max(lvl) FROM top) AS steps, coalesce(if(r.tampered, r.changed, r.leaf)) AS start
  FROM ranked r JOIN subroots s ON r.grp IS NOT DISTINCT FROM s.grp),
sides AS (
  SELECT h.doc_id, k.step, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.before), '') AS l, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (NOT o.before), '') AS r
  FROM heights h, LATERAL (SELECT unnest(range(h.steps)) AS step) k LEFT JOIN others o ON o.doc_id = h.doc_id AND o.step = k.step GROUP BY h.doc_id, k.step),
folding AS (
  SELECT doc_id, 0::BIGINT AS step, start AS h FROM heights
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(s.l || f.h || s.r) FROM folding f JOIN sides s ON s.doc_id = f.doc_id AND s.step = f.step),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS siblings FROM sides GROUP BY doc_id),
roots AS (SELECT h AS root FROM top WHERE n = 1)
SELECT r.doc_id, r.leaf, h.subroot, roots.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = roots.root AS verified
FROM ranked r JOIN heights h USING (doc_id) CROSS JOIN roots LEFT JOIN proofs p USING (doc_id) JOIN folding f ON f.doc_id = r.doc_id AND f.step = h.steps""",
}
