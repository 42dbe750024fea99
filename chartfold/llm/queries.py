"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartfold.llm import (
    align, backtrack_bpe, bpe_count, chat, jaccard, langid, lexical, linecrf, mixing, multiindex, piece_nbest, qda, reshard,
)
from chartfold.sources.scratch import shared_dir, stored

QUERIES = {}
SQL = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


@query()
def op6_token_counts(spark, d):
    return bpe_count.token_counts(table(spark, d, "documents"), PIECE_MODEL)


@query(r"""
    WITH turns AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), sized AS (
        SELECT *, length(text) + (length(text) - length(replace(text, chr(92), '')))
                  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
                  + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS escaped
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('### ') + length(role) + length(': ') + escaped + length(' </turn>') + 1) AS BIGINT)
               AS formatted_chars
    FROM sized GROUP BY conv_id
""")
def op8_chat_formatting(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat.read_back(chat.format_chat(turns.unionByName(added)))


@query()
def op10_quality_rules(spark, d):
    docs = table(spark, d, "documents")
    return linecrf.quality_rules(docs, linecrf.train(docs, table(spark, d, "labels")))


@query(r"""
    WITH entries AS (
        SELECT doc_id, md5(text) AS h, source, count(*) AS n_rows,
               max(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS size
        FROM documents GROUP BY 1, 2, 3
    ), sources AS (
        SELECT source, sum(size * n_rows) AS source_size,
               [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
        FROM entries GROUP BY 1
    ), filled AS (
        SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio,
               sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
               sum(3 * source_size) OVER o AS caps, sum(w) OVER o AS ws
        FROM sources WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
    ), marked AS (
        SELECT *, ratio <= CAST(total - (caps - cap) AS DOUBLE) / (all_w - (ws - w)) AS is_full FROM filled
    ), aims AS (
        SELECT source, source_size, total, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
            w * (CAST(total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE)
                 / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS target
        FROM marked
    ), queued AS (
        SELECT e.*, source_size, target, total, md5(concat_ws('/', doc_id, h, '0')) AS place,
               sum(size * n_rows) OVER (PARTITION BY e.source ORDER BY md5(concat_ws('/', doc_id, h, '0')), doc_id, h) AS upto
        FROM entries e JOIN aims a ON e.source IS NOT DISTINCT FROM a.source
    ), served AS (
        SELECT *, CAST(r * source_size + upto AS DOUBLE) / target AS t
        FROM queued CROSS JOIN (SELECT unnest([0, 1, 2]) AS r)
        WHERE size > 0 AND r * source_size + upto - size * n_rows < target
    ), spent AS (
        SELECT *, sum(size * n_rows) OVER (
            ORDER BY t, source NULLS FIRST, place, doc_id NULLS FIRST, h NULLS FIRST, r ROWS UNBOUNDED PRECEDING) AS s
        FROM served
    ), copies AS (SELECT doc_id, h, source, count(*) AS n FROM spent WHERE s <= total GROUP BY 1, 2, 3)
    SELECT q.doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST(size * coalesce(n, 0) AS BIGINT) AS taken
    FROM (SELECT *, unnest(range(n_rows)) AS copy FROM queued) q
    LEFT JOIN copies c ON q.doc_id IS NOT DISTINCT FROM c.doc_id AND q.h IS NOT DISTINCT FROM c.h
        AND q.source IS NOT DISTINCT FROM c.source
""")
def op3_source_mixing(spark, d):
    return mixing.report(mixing.mix(table(spark, d, "documents")))


@query()
def op4_resharding(spark, d):
    """From 32 shards by a hash of the id to 40 of equal bytes.

    The affected shards are written to the shared folder; the result comes from
    what is read there, and from the documents of the shards that stay as they are.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 16).cast("bigint")
    docs = table(spark, d, "documents").select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), size.alias("size"),
        F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int").alias("old_shard"), F.xxhash64("doc_id", F.lit(1)).alias("hash"),
    )
    keys = ["hash", "doc_id", "file", "row"]
    moves = reshard.plan(docs.select(*keys, "size", "old_shard"), "old_shard", "size", keys, 32, 40)
    path = shared_dir(spark, "shards")
    reshard.rewrite(docs, moves, path)
    shown = [F.col("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32")]
    found = reshard.written(spark, path, "doc_id bigint, text string", *shown)
    if len(moves.touched) < 40:
        left = moves.placed.filter(~F.col("shard").isin(moves.touched)).select("file", "row", "shard", "slot")
        untouched = docs.filter(~F.col("old_shard").isin(moves.touched)).select("file", "row", *shown)
        found = found.unionByName(untouched.join(left, ["file", "row"]).drop("file", "row"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query(r"""
    WITH RECURSIVE split AS (
        SELECT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM split WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    met AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)
    ), reached AS (
        SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
    )
    SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
    FROM documents d JOIN reached r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY 1
""")
def op5_jaccard_join(spark, d):
    return jaccard.jaccard_components(table(spark, d, "documents"), k=3, percent=90)


@query()
def op7_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    return qda.score_quality(docs, qda.train(docs, table(spark, d, "labels")))


@query()
def op9_language_id(spark, d):
    docs = table(spark, d, "documents")
    return langid.identify(docs, langid.train(docs))


@query()
def op2_piece_nbest(spark, d):
    """Pieces of every whole text, the best three segmentations, and whether decoding gives the text back."""
    encoded = piece_nbest.encode(table(spark, d, "documents"), PIECE_MODEL, n=3)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "score", F.xxhash64("ids").alias("ids_hash"),
        (F.size("others") + 1).alias("n_best"), F.get("others", F.lit(0)).getField("score").alias("second_score"),
        F.get("others", F.lit(1)).getField("score").alias("third_score"), "round_trip",
    )


@query()
def op1_embedding_near_dedup(spark, d):
    return multiindex.near_copies(table(spark, d, "embeddings"))


@query()
def op11_bpe_encoding(spark, d):
    """Tokens of every whole text, and the text that they decode to."""
    encoded = backtrack_bpe.encode(table(spark, d, "documents"), WORD_MODEL)
    return backtrack_bpe.decode(encoded, WORD_MODEL).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(r"""
    WITH docs AS (
        SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents
    ), sizes AS (SELECT d, doc_id, len(ts) AS n FROM docs WHERE len(ts) > 0),
    corpus AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM sizes),
    held AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM docs) GROUP BY 1, 2),
    asked AS (
        SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2
    ), weights AS (
        SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM held CROSS JOIN corpus GROUP BY t
    ), scored AS (
        SELECT item_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS score
        FROM asked JOIN weights USING (t) JOIN held USING (t) JOIN sizes USING (d) CROSS JOIN corpus GROUP BY 1, 2
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
           doc_id, CAST(score AS BIGINT) AS score
    FROM scored JOIN sizes USING (d) WHERE score > 0 QUALIFY rank <= 20
""")
def op12_lexical_search(spark, d):
    index = lexical.build_index(table(spark, d, "documents"))
    return lexical.search(index, table(spark, d, "benchmark"), k=20)


@query()
def op13_token_alignment(spark, d):
    return align.align(table(spark, d, "documents"), BYTE_MODEL, PIECE_MODEL)
