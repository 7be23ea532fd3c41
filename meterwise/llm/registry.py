"""The queries of this subpackage, one for each operator with its production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_decode, bpe_encode
from .collocations import collocations
from .common import table
from .exact_dedup import exact_groups
from .fingerprints import edited_copies
from .image_copies import drawn, image_copies
from .licenses import corpus_lines, license_scan, train_scanner
from .minhash_dedup import near_duplicates
from .packing import best_fit_packing
from .pii import pseudonymised, session_key
from .prefix_trie import conversation_trie
from .substring_dedup import remove_repeats
from .toxicity import classify, labelled_chain
from .warc import archived_pages


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so every row of embeddings is drawn as an image; each row whose id is divisible by 20
    has a cropped and edited copy besides, which must be found among all images."""
    return image_copies(drawn(table(spark, sf_dir, "embeddings")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    decoded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), session_key(spark), count_col="n_values").select("doc_id", "n_values", "text")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2, capacity=1024)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"), least=0)


#: Base 32: letter i holds the five bits from bit 5 * i on, which lie in two hexadecimal digits.
OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload FROM pages),
b AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((
    16 * (strpos('0123456789abcdef', substr(hex, (5 * i) // 4 + 1, 1)) - 1) + (CASE WHEN (5 * i) // 4 + 2 <= 40 THEN strpos('0123456789abcdef', substr(hex, (5 * i) // 4 + 2, 1)) - 1 ELSE 0 END)
  ) >> (3 - (5 * i) % 4)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d WHERE len(words) >= 13),
v AS (SELECT doc_id, i, list_slice(words, i, i + 12) AS seq FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first FROM v) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare
  FROM documents
), g AS (
  SELECT doc_id, sha256(bare) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license_scan(docs, train_scanner(corpus_lines(docs)))
    return found.select("doc_id", F.array_distinct("spans.family").alias("families"), F.size("spans").cast("long").alias("n_spans"), F.array_max("spans.probability").alias("probability"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS shingle FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, labelled_chain(docs, table(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
total AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
gram AS (
  SELECT lang, words[i : i + k - 1] AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k)
), f AS (SELECT lang, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
within AS (
  SELECT lang, part, max(f) AS longer FROM (SELECT lang, f, unnest([phrase[1 : len(phrase) - 1], phrase[2 : len(phrase)]]) AS part FROM f WHERE len(phrase) > 2) GROUP BY ALL
), own AS (
  SELECT f.* FROM f LEFT JOIN within ON f.lang = within.lang AND f.phrase = within.part WHERE len(f.phrase) > 1 AND (longer IS NULL OR 100 * longer < 100 * f.f)
), cut AS (
  SELECT o.lang, o.phrase, o.f AS a, k, x.f AS l, y.f AS r, n, 1000 * o.f * n // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM own) o JOIN f x ON x.lang = o.lang AND x.phrase = o.phrase[1 : k] JOIN f y ON y.lang = o.lang AND y.phrase = o.phrase[k + 1 : len(o.phrase)]
    JOIN total t ON t.lang = o.lang
), least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cut),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM least WHERE nth = 1
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit: 3988292384 is its reversed polynomial.
OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, k: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, i AS pos, said FROM c JOIN t ON t.conv_id = c.base AND i < h UNION ALL SELECT c.conv_id, 4 + i, said FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h
), s AS (
  SELECT c.conv_id, coalesce(list(said ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), m AS (
  SELECT conv_id, depth, sha256(to_json(turns[1 : depth])::VARCHAR) AS key, CASE WHEN depth > 0 THEN sha256(to_json(turns[1 : depth - 1])::VARCHAR) END AS parent, depth = len(turns) AS ends,
    CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].text, '[^ 	-]+')) ELSE 0 END AS words FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM s)
), node AS (
  SELECT key, depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY key, depth
), child AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child ON child.key = node.key AND child.depth = node.depth),
tree AS (
  SELECT m.key, m.depth, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
  FROM own v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY ALL
)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN tree ON tree.key = o.key AND tree.depth = o.depth LEFT JOIN own p ON p.key = o.parent AND p.depth = o.depth - 1
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_copies(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_image_copies": op1_image_copies,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_pii": op3_pii,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_warc": op5_warc,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_collocations": op11_collocations,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_fingerprints": op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": OP5_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op9_minhash_dedup": OP9_SQL,
        "op11_collocations": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
    }
