"""One named query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import byte_pairs
from faultline.llm.common import documents, prepared
from faultline.llm.digest_index import DigestIndex, deduplicate
from faultline.llm.html_text import extract
from faultline.llm.id_files import store_ids
from faultline.llm.infill import fill_in_middle, restored
from faultline.llm.language import identify_documents
from faultline.llm.manifest import REACH, build_manifest, folded, leaf_of, proof_digest
from faultline.llm.packing import pack
from faultline.llm.pieces import encode_documents
from faultline.llm.quality import judge, learned
from faultline.llm.quotes import link_quotes, quoting
from faultline.llm.sharding import shard_documents
from faultline.llm.simhash import near_duplicates

SHARDS = 24


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the rules learned from the labels."""
    docs = documents(spark, sf_dir)
    rules = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules, "doc_id")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order without quotations, after each turn quotes the two before it."""
    return link_quotes(quoting(prepared(spark).read.parquet(f"{sf_dir}/conversations.parquet")), trimmed=True)


OP2_SQL = r"""
    WITH RECURSIVE said AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text,
             trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain
      FROM conversations),
    units AS (
      SELECT conv_id, turn, plain FROM said
      UNION
      SELECT conv_id, turn, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')
      FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM said)),
    firsts AS (SELECT conv_id, plain, min(turn) AS origin FROM units WHERE plain <> '' GROUP BY ALL),
    linked AS (
      SELECT m.*, coalesce((p.plain <> '')::INT, 0) + coalesce((g.plain <> '')::INT, 0) AS n_quotes, coalesce(f.origin, -1) AS parent_turn
      FROM said m LEFT JOIN said p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1
      LEFT JOIN said g ON g.conv_id = m.conv_id AND g.turn = m.turn - 2
      LEFT JOIN firsts f ON f.conv_id = m.conv_id AND f.plain = p.plain),
    threads AS (
      SELECT conv_id, turn, turn AS thread FROM linked WHERE parent_turn = -1
      UNION ALL
      SELECT l.conv_id, l.turn, t.thread FROM linked l JOIN threads t ON t.conv_id = l.conv_id AND t.turn = l.parent_turn)
    SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS position,
           parent_turn, n_quotes::BIGINT AS n_quotes, n_quotes::BIGINT AS n_linked,
           regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body,
           '<|im_start|>' || coalesce(role, 'user') || chr(10)
             || regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') || '<|im_end|>' AS chat
    FROM linked JOIN threads USING (conv_id, turn)"""


def op3_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and checksums of every document's pieces, and whether they decode to the text."""
    return encode_documents(documents(spark, sf_dir))


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to files of patched blocks and read back."""
    return store_ids(documents(spark, sf_dir), "byte_bpe_50k.json")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for each text, against an index that starts empty."""
    with DigestIndex(spark) as index:
        return deduplicate(documents(spark, sf_dir), index)


OP5_SQL = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_documents(documents(spark, sf_dir), SHARDS)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return pack(documents(spark, sf_dir), "word_bpe_49k.json")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract(prepared(spark).read.parquet(f"{sf_dir}/pages.parquet"), "html", "page_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify_documents(documents(spark, sf_dir))


def byte_pair_digests(docs: DataFrame) -> DataFrame:
    """Count and digest of every document's ids, and the digest of what they decode to."""
    coded = byte_pairs.decoded(byte_pairs.encoded(docs))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair ids of every document, and back."""
    return byte_pair_digests(documents(spark, sf_dir))


def manifest_rows(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Every document's leaf, proof and the root that its leaf gives after texts were tampered with.

    Where 2 divides the checksum of the decimal doc_id, line ends are deleted; a null doc_id has no checksum.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    made = build_manifest(docs, reach, altered=leaf_of(text=F.coalesce(tampered, F.col("text"))))
    root, path = F.lit(made.root).cast("string"), F.col("path")
    rows = made.proofs().select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest(path).alias("proof_sha256"),
        folded(F.col("altered"), path).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and checked proof of every document."""
    return manifest_rows(documents(spark, sf_dir))


OP12_SQL = r"""
    WITH RECURSIVE given AS (
      SELECT *, doc_id::VARCHAR AS id,
             CASE WHEN list_reduce(
                 list_concat([4294967295::BIGINT], list_transform(range(1, length(id) + 1), lambda k: ascii(id[k])::BIGINT)),
                 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                     lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 2 = 1
               THEN replace(text, chr(10), '') ELSE text END AS tampered
      FROM documents),
    fields AS (
      SELECT *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
      FROM given),
    leaves AS (
      SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS altered
      FROM fields),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
    trees AS (
      SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY source
      UNION ALL
      SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda k: sha256(array_to_string(nodes[k + 1:k + 3], '')))
      FROM trees WHERE len(nodes) > 1),
    climbed AS (
      SELECT doc_id, source, leaf, 0 AS level, i, altered AS node, '' AS proof FROM placed
      UNION ALL
      SELECT c.doc_id, c.source, c.leaf, c.level + 1, c.i // 3,
             sha256(array_to_string(nodes[i - i % 3 + 1:i], '') || c.node || array_to_string(nodes[i + 2:i - i % 3 + 3], '')),
             c.proof || array_to_string(nodes[i - i % 3 + 1:i], '') || array_to_string(nodes[i + 2:i - i % 3 + 3], '')
      FROM climbed c JOIN trees t ON t.source IS NOT DISTINCT FROM c.source AND t.level = c.level WHERE len(t.nodes) > 1),
    subroots AS (
      SELECT source, level, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j
      FROM trees WHERE len(nodes) = 1),
    tops AS (
      SELECT 0 AS level, list(subroot ORDER BY j) AS nodes FROM subroots HAVING count(*) > 0
      UNION ALL
      SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda k: sha256(array_to_string(nodes[k + 1:k + 3], '')))
      FROM tops WHERE len(nodes) > 1),
    finished AS (
      SELECT c.doc_id, c.leaf, s.subroot, 0 AS level, s.j AS i, c.node, c.proof
      FROM climbed c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source AND s.level = c.level
      UNION ALL
      SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.i // 3,
             sha256(array_to_string(nodes[i - i % 3 + 1:i], '') || f.node || array_to_string(nodes[i + 2:i - i % 3 + 3], '')),
             f.proof || array_to_string(nodes[i - i % 3 + 1:i], '') || array_to_string(nodes[i + 2:i - i % 3 + 3], '')
      FROM finished f JOIN tops t ON t.level = f.level WHERE len(t.nodes) > 1)
    SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = nodes[1] AS verified
    FROM finished f JOIN tops t ON t.level = f.level WHERE len(t.nodes) = 1"""


def infill_digests(docs: DataFrame) -> DataFrame:
    """Every document's transformed text as a digest, and that of the text rebuilt from it."""
    rows = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{n}_sha256") for n, c in (("output", F.col("output")), ("restored", back))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, middle and suffix of every document in an order to learn filling in from."""
    return infill_digests(documents(spark, sf_dir))


OP13_SQL = r"""
    WITH drawn AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    cut AS (
      SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, len(units)::BIGINT AS n,
             ('0x' || h[1:8])::BIGINT % (n + 1) AS one, ('0x' || h[9:16])::BIGINT % (n + 1) AS two,
             ('0x' || h[25:32])::BIGINT % 100 AS h4
      FROM drawn),
    parts AS (
      SELECT doc_id, text, n, array_to_string(units[1:least(one, two)], '') AS p,
             array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS m,
             array_to_string(units[greatest(one, two) + 1:], '') AS s,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                  WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM cut)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                  ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_piece_coding": op3_piece_coding,
    "op4_token_id_files": op4_token_id_files,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sharding": op6_sharding,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE: dict[str, str] = {"op2_quotation_linking": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op12_merkle_manifest": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
